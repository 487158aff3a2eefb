"""Text scanners against plain regular expressions and the tokenizers library; edge rows for all of them."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locarium.llm import bpe, license_scan, pii, secret_scan
from locarium.llm.automaton import compile_rules, parse

LONG = "wort " * 40_000
EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "mail a@b.co now"), (4, "mail a@b.co now"), (None, "x"), (5, LONG)]


def edge_docs(spark):
    rows = [(i, t, "en", "s", 9, "clash", [1]) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, found array<int>")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def base_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


PII_PARTS = [*"0123456789 -.@+()aZ%é\n", "4111 1111 1111 1111", "a@b.c", "127.0.0.1", ".com", "+1 (555) 123-4567"]
SECRET_PARTS = ["password", "Token", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "abcd", "é", "12345678", "-", "ſecret", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PII_PARTS), max_size=25).map("".join))
def test_pii_base_spans(text):
    assert [x[:3] for x in pii.find_pii(text) if pii.KINDS[x[1]].base] == base_pii(text)


SCANNER = secret_scan.Scanner()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SECRET_PARTS), max_size=15).map("".join))
def test_secret_base_spans(text):
    assert [x for x in SCANNER.spans(text) if x[1] < 3] == base_secrets(text)


def test_added_kinds():
    said = {pii.KINDS[k].name: s for _, k, _, s in pii.find_pii("bank account GB82 WEST 1234 5698 7654 32, social security 078-05-1120")}
    assert said["iban"] == 1.0 and said["ssn"] == 0.6
    assert not [x for x in pii.find_pii("part 078-05-1120, GB82 WEST 1234 5698 7654 33") if pii.KINDS[x[1]].name in ("ssn", "iban")]
    found = {SCANNER.rules[k].kind for _, k, _ in SCANNER.spans("ghp_" + "a1B2" * 9 + " AIza" + "x" * 35 + " -----BEGIN RSA PRIVATE KEY-----")}
    assert found >= {"github", "google", "pem"}


@pytest.mark.parametrize("pattern", ["a(b|cd)*e?", "[a-c]{2,3}x", "(ab?){2}|c+", "[^a]b{3,}"])
def test_automaton(pattern):
    a = compile_rules([parse(pattern)], anchored=True)
    rng = random.Random(7)
    for _ in range(3000):
        s = "".join(rng.choices("abcdex", k=rng.randint(0, 8)))
        at = a.start
        for b in s.encode():
            at = a.moves[at + b]
        assert (at in a.hits) == bool(re.fullmatch(pattern, s)), (pattern, s)


def test_scan_queries_on_edge_rows(spark):
    docs = edge_docs(spark)
    kinds = [k.name for k in pii.KINDS if k.base]
    rows = pii.scan_pii(docs).select("doc_id", *secret_scan.digest_columns(pii.F.col("found"), kinds)).collect()
    assert len(rows) == len(EDGE)
    four = [r for r in rows if r.doc_id == 4]
    assert len(four) == 2 and four[0] == four[1] and four[0].n_email == 1 and four[0].base_sha256 == sha("email:5:11") and four[0].spans == "email:5:11"
    assert all(r.base_sha256 == sha("") and r.spans == "" for r in rows if r.doc_id != 4)
    for op in (pii.scan_pii, secret_scan.scan_secrets, license_scan.scan_licenses, bpe.encode_documents):
        assert op(docs).count() == len(EDGE)
        assert op(empty_docs(spark)).count() == 0


def test_redact(spark):
    text = "é password=abcdefgh1 end " + "0" * 32
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")
    df = df.withColumn("s", secret_scan.secret_spans()("text")).select("doc_id", secret_scan.redact(secret_scan.F.col("text"), secret_scan.F.col("s")).alias("t"))
    assert {r.doc_id: r.t for r in df.collect()} == {1: "é <ASSIGN> end <HEX>", 2: None, 3: "plain"}


def test_licenses():
    s = license_scan.LicenseScanner()
    name = lambda t: [x[0] for x in s.licenses(t)]
    assert name("Some prose here.\nLicensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert name("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3"]
    assert name("Released under the MIT licence. Licensed under CC BY-NC 4.0.") == ["MIT", "CC-BY-NC-4.0"]
    assert name("He licensed nothing of that kind.") == ["unknown"] and name("no words of that sort") == []
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, express."
    assert s.licenses(full) == [("MIT", 0, len(full))]


def test_license_rules_against_brute_force():
    rng, s = random.Random(3), license_scan.LicenseScanner()
    lines = ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License.", "Released under the MIT License.", "The mud is deep.", "All rights reserved."]
    ids = ["apache-by", "apache-use", "mit-by", "", "rights"]
    for _ in range(200):
        picks = [rng.randrange(5) for _ in range(rng.randint(0, 7))]
        seq, want, k = [ids[p] for p in picks if ids[p]], [], 0
        while k < len(seq):
            rule = next((r for r in license_scan.RULES if tuple(seq[k : k + len(r.sentences)]) == r.sentences), None)
            want.append(rule.name.replace("{version}", "2.0") if rule else "unknown")
            k += len(rule.sentences) if rule else 1
        assert [x[0] for x in s.licenses("\n".join(lines[p] for p in picks))] == want


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Neither the name of the holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


@pytest.mark.parametrize("text, want", [(MIT, "MIT"), (GPL, "GPL-3+"), (BSD, "BSD-3-Clause"), (APACHE, "Apache-2.0")])
def test_wrapped_licenses(text, want):
    s = license_scan.LicenseScanner()
    assert s.licenses(text) == [(want, 0, len(text))]
    for mark in ("# ", " * ", "// ", "; "):
        commented = "\n".join((mark + line).rstrip() for line in text.split("\n"))
        assert s.licenses(commented) == [(want, 0, len(commented))]
    unwrapped = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
    assert s.licenses(unwrapped) == [(want, 0, len(unwrapped))]
    windows = text.replace("\n", "\r\n")
    assert s.licenses(windows) == [(want, 0, len(windows))]
    assert [x[0] for x in s.licenses(f"Some prose here\n\n{text}\n\nReleased under the MIT license\nmore prose")] == [want, "MIT"]


INSTALLED = [
    ("attrs", "MIT"), ("duckdb", "MIT"), ("pytest", "MIT"), ("pyyaml", "MIT"), ("urllib3", "MIT"), ("pip", "MIT"), ("py4j", "BSD-3-Clause"), ("psutil", "BSD-3-Clause"),
    ("numpy", "BSD-3-Clause"), ("zstandard", "BSD-3-Clause"), ("xxhash", "BSD-2-Clause"), ("requests", "Apache-2.0"), ("sortedcontainers", "Apache-2.0"), ("certifi", "MPL-2.0"), ("hypothesis", "MPL-2.0"),
]


@pytest.mark.parametrize("package, want", INSTALLED)
def test_license_files_of_installed_packages(package, want):
    """Texts that the rules weren't written from."""
    from importlib import metadata

    try:
        files = [f for f in metadata.files(package) or () if f.name.upper().startswith("LICENSE") and f.suffix in ("", ".txt", ".md")]
    except metadata.PackageNotFoundError:
        files = []
    if not files:
        pytest.skip("not installed with its license")
    found = [x[0] for f in files for x in license_scan.LicenseScanner().licenses(f.read_text(encoding="utf-8"))]
    assert want in found


def test_distant_sentences_and_expressions():
    s = license_scan.LicenseScanner()
    first, second = "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License."
    far = f"{first}\n\n{'Prose stands here. ' * 700}\n\n{second}"
    assert s.licenses(far) == [("Apache-2.0", 0, len(first)), ("unknown", len(far) - len(second), len(far))]
    near = f"{first}\n\nProse stands here.\n\n{second}"
    assert s.licenses(near) == [("Apache-2.0", 0, len(near))]
    name = lambda t: [x[0] for x in s.licenses(t)]
    assert name("// SPDX-License-Identifier: Apache-2.0 OR MIT") == ["SPDX:apache-2.0 OR mit"]
    assert name("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */") == ["SPDX:gpl-2.0-only WITH linux-syscall-note"]
    assert name("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.") == ["LGPL-2.1+"]


def test_sentence_map_against_brute_force():
    """Every spelling of every sentence with its slots filled gives its identifier, and nothing else does."""
    fill = {"<version>": "2.0", "<word>": "work", "<name>": "the holder", "<expression>": "mit or isc", "<rest>": "and so on"}
    m = license_scan.SentenceMap(license_scan.SENTENCES)
    for name, templates in license_scan.SENTENCES.items():
        for words in (w for t in templates for w in license_scan.spelled(t)):
            kinds = license_scan.KINDS.get(name, ("",))
            plain = " ".join(fill.get(w, kinds[0] if w == "<kind>" else w) for w in words).split()
            found = m.find(plain, 0, {len(plain)}, len(plain))
            assert found and found[:2] == (len(plain), name), plain
            assert len(set(plain)) < 4 or m.find(plain[::-1], 0, {len(plain)}, len(plain)) is None


def test_one_line_notices_among_lines():
    s = license_scan.LicenseScanner()
    text = "a line of prose\nReleased under the MIT License\nanother line\nLicensed under the GNU General Public License\nversion 2\nCopyright 2020 A\nAll rights reserved\nlast"
    assert [(n, text[a:b].split("\n")[0]) for n, a, b in s.licenses(text)] == [("MIT", "Released under the MIT License"), ("GPL-2", "Licensed under the GNU General Public License"), ("All-Rights-Reserved", "Copyright 2020 A")]
    assert [x[0] for x in s.licenses("Copyright 2020 A\nReleased under the MIT License\nAll rights reserved")] == ["MIT", "All-Rights-Reserved"]
    assert [x[0] for x in s.licenses("This work is\nlicensed under the MIT License\nSPDX-License-Identifier: MIT")] == ["MIT", "SPDX:mit"]
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    assert s.licenses(mpl) == [("MPL-2.0", 0, len(mpl))]
    assert [x[0] for x in s.licenses("all\n * rights\n * reserved")] == ["All-Rights-Reserved"]


@pytest.fixture(scope="module")
def machine():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    return bpe.Transducer(path), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from([*"abetnsE ñ\t’'日", "<|endoftext|>", "'re", " the", "\r\n", "😀", "́", "½"]), max_size=40).map("".join)))
def test_bpe_equals_library(machine, text):
    own, library = machine
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert "".join(own.decode(want, step=3)) == library.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, "=" * 3000, " " * 3000 + "x", "日本" * 2000, "".join(random.Random(1).choices("abcdefghijst", k=20_000))])
def test_long_pieces_stream(machine, text):
    own, library = machine
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    data = text.encode()
    if " " not in text:
        assert list(own.stream(data[k : k + 7] for k in range(0, len(data), 7))) == want


def test_utf8_machine():
    rng = random.Random(5)
    for _ in range(2000):
        data = bytes(rng.choices([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0], k=rng.randint(0, 12)))
        m, out, k = bpe.Utf8Machine(), "", 0
        while k < len(data):
            n = rng.randint(1, 3)
            out += m.feed(data[k : k + n])
            k += n
        assert out + m.end() == data.decode("utf-8", "replace")


def test_encode_decode_documents(spark):
    docs = edge_docs(spark)
    coded = bpe.encode_documents(docs, with_ids=True)
    back = {(r.doc_id, r.text) for r in bpe.decode_documents(coded).collect()}
    assert back == {(i, t or "") for i, t in EDGE}
    r = {x.doc_id: x for x in coded.collect()}
    assert r[1].n_tokens == 0 and r[1].decoded_sha256 == sha("") and np.frombuffer(r[4].ids, "<u4").size == r[4].n_tokens
