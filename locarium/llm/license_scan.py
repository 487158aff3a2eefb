"""License scans by sentence rules.

A text is cut into sentences at end marks and blank lines, and these into pieces
at single newlines and ``;``. Each piece is normalised (without comment marks)
and, from each piece on, the longest run of pieces that is a known license
sentence is looked up, so that wrapped sentences and one-line notices are found
alike. Known sentences are kept as a map from their words to identifiers, with
slots for names, years and versions, so that a look-up takes one step a word
however many sentences are known. The sequence of identifiers then goes through
one automaton for all rules: at each place the first rule whose identifiers stand
there, not too far from each other, wins. What stands between and speaks of a
license but isn't known is reported as ``unknown``.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table, text_udf

#: Identifier -> normalised sentences of published license texts. ``[...]`` may be left out, ``(a|b)``
#: is either; ``<version>``, ``<kind>`` and ``<word>`` are one word, ``<name>`` up to twelve, ``<expression>`` names
#: joined by and, or and with, ``<rest>`` what is left of the sentence.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-by": ("[this <word> is] (licensed|released|distributed) under [the terms of] the apache license [version] <version> [the license]",),
    "apache-title": ("apache license version <version> <word> <word>",),
    "apache-use": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at <rest>",),
    "gpl-by": ("[this <word> is] (licensed|released|distributed) under [the terms of] the gnu [<kind>] general public license [version] [<version>]",),
    "gpl-title": ("gnu [<kind>] general public license version <version> <word> <word> <word>",),
    "gpl-free": ("<name> is free software you can redistribute it and or modify it under the terms of the gnu [<kind>] general public license as published by the free software foundation either version <version> of the license or at your option any later version",),
    "gpl-only": ("<name> is free software you can redistribute it and or modify it under the terms of [version <version> of] the gnu [<kind>] general public license [version <version>] [of the license] [only] [as published by the free software foundation]",),
    "gpl-useful": ("<name> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "mit-by": ("[this <word> is] (licensed|released|distributed) under [the terms of] the mit license", "[the] mit license [mit]"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and [its] associated documentation [files] [<rest>]",),
    "mit-notice": ("the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software",),
    "as-is": ("(the|this) software is provided as is [and] without warranty of any kind [<rest>]", "the software is provided as is and <name> disclaims all warranties <rest>"),
    "bsd-grant": ("redistribution and use in source and binary forms [of the software as well as documentation] with or without modification are permitted provided that the following conditions are met [<rest>]",),
    "bsd-source": ("[<word>] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [<rest>]",),
    "bsd-binary": ("[<word>] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-names": ("[<word>] neither the name [of] <name> nor the names of [its|any] contributors may be used to endorse or promote products derived from this software without specific prior written permission", "[<word>] [neither] the (name|names) of <name> may [not] be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-as-is": ("this software is provided by <name> as is and any express or implied warranties [<rest>]",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted [provided that the above copyright notice and this permission notice appear in all copies]",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "boost-grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license <rest>",),
    "unlicense-grant": ("this is free and unencumbered software released into the public domain",),
    "psf-title": ("python software foundation license version <version>",),
    "cc-by": ("[this <word> is] (licensed|released|distributed) under [a|the] (cc|creative commons) <kind> [license] [<version>] [<word>] [license]",),
    "mpl-by": ("this source code form is subject to the terms of the mozilla public license v <version>", "[this <word> is] (licensed|released|distributed) under the mozilla public license [version] <version>"),
    "mpl-title": ("mozilla public license version <version>",),
    "epl-by": ("this program and the accompanying materials are made available under the terms of the eclipse public license [v|version] <version> <rest>",),
    "spdx": ("spdx-license-identifier <expression>",),
    "rights": ("[copyright <rest>] all rights reserved",),
}
#: Words that ``<kind>`` stands for, by sentence; others stand for any word.
KINDS = {name: ("lesser", "affero", "library") for name in ("gpl-by", "gpl-title", "gpl-free", "gpl-only")}
KINDS["cc-by"] = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd", "zero", "0", "cc0")


@dataclass(frozen=True)
class LicenseRule:
    """``name`` may use {version}, {kind} and {expression} of its sentences."""

    name: str
    sentences: tuple[str, ...]


#: In order: longer sequences before their beginnings.
RULES = (
    LicenseRule("Apache-{version}", ("apache-by", "apache-use", "apache-copy")),
    LicenseRule("Apache-{version}", ("apache-by", "apache-use")),
    LicenseRule("Apache-{version}", ("apache-by",)),
    LicenseRule("Apache-{version}", ("apache-title",)),
    LicenseRule("{kind}GPL-{version}+", ("gpl-free", "gpl-useful")),
    LicenseRule("{kind}GPL-{version}+", ("gpl-free",)),
    LicenseRule("{kind}GPL-{version}", ("gpl-only", "gpl-useful")),
    LicenseRule("{kind}GPL-{version}", ("gpl-only",)),
    LicenseRule("{kind}GPL-{version}", ("gpl-by",)),
    LicenseRule("{kind}GPL-{version}", ("gpl-title",)),
    LicenseRule("MIT", ("mit-by", "mit-grant", "mit-notice", "as-is")),
    LicenseRule("MIT", ("mit-grant", "mit-notice", "as-is")),
    LicenseRule("MIT", ("mit-grant", "mit-notice")),
    LicenseRule("MIT", ("mit-by",)),
    LicenseRule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    LicenseRule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    LicenseRule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-names")),
    LicenseRule("BSD-3-Clause", ("bsd-grant", "bsd-names")),
    LicenseRule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    LicenseRule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    LicenseRule("BSD-2-Clause", ("bsd-grant",)),
    LicenseRule("ISC", ("isc-grant", "as-is")),
    LicenseRule("ISC", ("isc-grant",)),
    LicenseRule("Zlib", ("zlib-grant",)),
    LicenseRule("BSL-1.0", ("boost-grant",)),
    LicenseRule("Unlicense", ("unlicense-grant",)),
    LicenseRule("PSF-{version}", ("psf-title",)),
    LicenseRule("CC-{kind}-{version}", ("cc-by",)),
    LicenseRule("MPL-{version}", ("mpl-by",)),
    LicenseRule("MPL-{version}", ("mpl-title",)),
    LicenseRule("EPL-{version}", ("epl-by",)),
    LicenseRule("SPDX:{expression}", ("spdx",)),
    LicenseRule("All-Rights-Reserved", ("rights",)),
)
#: Sentences of one license may stand this many characters apart.
FARTHEST = 400
#: Only sentences that hold one of these can be known, or speak of a license.
ANCHORS = ("licen", "free software", "without any warranty", "as is", "permission", "redistribution", "rights reserved", "public domain", "contributors may")
_WIDE = [re.compile(r"\W+".join(a.split())) for a in ANCHORS if " " in a]
_BREAK = re.compile(r"(?<=[.!?])\s+|(?<=[^\s;#*/];)\s+|\n+")
_EDGE = re.compile(r"^[\s#*/;%\-<>!|]+|[\s.!?:;,*/#\-<>|]+$")
_MARK = re.compile(r"[\"'“”‘’()<>,;/:]+|(?<![0-9])\.|\.(?![0-9])")
_SPEAKS = re.compile(r"\blicens(?:e|ed|es)\b")


def normalised(sentence: str) -> str:
    """Lower case, one spelling of license, no quotes, brackets and commas, single spaces."""
    s = _EDGE.sub("", sentence.lower()).replace("licence", "license")
    return " ".join(_MARK.sub(" ", s).split())


def spelled(template: str) -> list[tuple[str, ...]]:
    """All word sequences of a template with optional and alternative parts."""
    m = re.search(r"\[([^\[\]()]*)\]|\(([^\[\]()]*)\)", template)
    if not m:
        return [tuple(template.split())]
    parts = (m[1] if m[1] is not None else m[2]).split("|") + [""] * (m[1] is not None)
    return list(dict.fromkeys(w for part in parts for w in spelled(template[: m.start()] + part + template[m.end() :])))


_VERSION = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")
_JOINS = ("and", "or", "with")


class SentenceMap:
    """Normalised sentence -> identifier, word by word: a node holds the next fixed words and slots."""

    def __init__(self, sentences: dict[str, tuple[str, ...]], kinds: dict[str, tuple[str, ...]] = KINDS):
        self.root: dict = {}
        self.kinds = kinds
        for name, templates in sentences.items():
            for words in itertools.chain.from_iterable(map(spelled, templates)):
                node = self.root
                for w in words:
                    node = node.setdefault((w, name) if w == "<kind>" else w, {})
                node.setdefault("", name)  # no word is blank

    def find(self, words: list[str], at: int, ends: set[int], limit: int) -> tuple[int, str, dict] | None:
        """(end, identifier, captured) of the longest sentence that begins at a word, ends where a
        piece does, and not beyond the limit."""
        best = None
        todo = [(self.root, at, {})]
        while todo:
            node, k, got = todo.pop()
            if "" in node and k in ends and k <= limit and (best is None or (k, len(got)) > (best[0], len(best[2]))):
                best = k, node[""], got
            if k < limit and words[k] in node:
                todo.append((node[words[k]], k + 1, got))
            for slot, then in node.items():
                if slot[:1] == "<" or isinstance(slot, tuple):
                    todo += self._filled(slot, then, words, k, limit, got)
        return best

    def _filled(self, slot, then: dict, words: list[str], k: int, limit: int, got: dict) -> list[tuple]:
        if slot == "<rest>":
            # to where a word that may follow stands, or to the end
            to = [j for j in range(k, min(limit, k + 40)) if words[j] in then] if len(then) > ("" in then) else []
            return [(then, j, got) for j in [*to, limit] if j > k or "" not in then]
        if k >= limit:
            return []
        w = words[k]
        if slot == "<name>":
            return [(then, j, got) for j in range(k + 1, min(limit, k + 13)) if words[j] in then]
        if slot == "<version>":
            return [(then, k + 1, got | {"version": w.lstrip("v")})] if _VERSION.fullmatch(w) else []
        if slot == "<word>":
            return [(then, k + 1, got)]
        if slot == "<expression>":
            j = k + 1
            while j + 1 < limit and words[j] in _JOINS:
                j += 2
            said = " ".join(x.upper() if x in _JOINS else x for x in words[k:j])
            return [(then, j, got | {"expression": said})]
        return [(then, k + 1, got | {"kind": w})] if w in self.kinds[slot[1]] else []


class RuleAutomaton:
    """All rules as one transition table over identifiers; a state says which rules end there."""

    def __init__(self, rules: tuple[LicenseRule, ...]):
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        for n, rule in enumerate(rules):
            at = 0
            for name in rule.sentences:
                if name not in self.moves[at]:
                    self.moves[at][name] = len(self.moves)
                    self.moves.append({})
                    self.ends.append(None)
                at = self.moves[at][name]
            if self.ends[at] is None:
                self.ends[at] = n

    def first(self, parts: list[tuple], k: int, farthest: int) -> tuple[int, int] | None:
        """(rule, place after it) of the first rule in order that stands at a place."""
        at, best, j = 0, None, k
        while j < len(parts) and (j == k or parts[j][0] - parts[j - 1][1] <= farthest) and parts[j][2] in self.moves[at]:
            at, j = self.moves[at][parts[j][2]], j + 1
            if self.ends[at] is not None and (best is None or self.ends[at] < best[0]):
                best = self.ends[at], j
        return best


class LicenseScanner:
    def __init__(self, sentences: dict[str, tuple[str, ...]] = SENTENCES, rules: tuple[LicenseRule, ...] = RULES, farthest: int = FARTHEST):
        self.sentences, self.rules, self.automaton, self.farthest = SentenceMap(sentences), rules, RuleAutomaton(rules), farthest

    @staticmethod
    def _pieces(text: str) -> list[list[tuple[int, int, str]]]:
        """Sentences as lists of (start, end, normalised) pieces. A number after a full stop (``v. 2.0``)
        and a paragraph that begins with a link belong to the sentence before."""
        out, at, ended, blank = [], 0, True, False
        for m in [*_BREAK.finditer(text), None]:
            end = m.start() if m else len(text)
            plain = normalised(text[at:end])
            if plain:
                if ended or (blank and not plain.startswith(("http ", "https "))):
                    out.append([])
                out[-1].append((at, end, plain))
                ended = blank = False
            else:
                blank = True
            if m:
                at = m.end()
                ended = ended or (text[end - 1 : end] in (".", "!", "?") and not text[at : at + 1].isdigit())
                blank = blank or m.group().count("\n") > 1
        return out

    def _known(self, pieces: list[tuple[int, int, str]]) -> dict[int, tuple[int, str, dict]]:
        """Piece -> (piece after the sentence, identifier, captured), where a known sentence begins.
        A sentence holds no beginning of another, but may be one with words before it."""
        words, places, ends = [], [], {}
        for k, (_, _, plain) in enumerate(pieces):
            places.append(len(words))
            words += plain.split(" ")
            ends[len(words)] = k + 1
        stops, out, following, limit = set(ends), {}, None, len(words)
        for k in range(len(pieces) - 1, -1, -1):
            found = self.sentences.find(words, places[k], stops, limit)
            if not found and following:
                last = places[following[0]] if following[0] < len(pieces) else len(words)
                found = self.sentences.find(words, places[k], {last}, last)
                found = found if found and found[1] == following[1] else None
            if found:
                out[k] = following = (ends[found[0]], *found[1:])
                limit = places[k]
        return out

    def identified(self, text: str) -> list[tuple[int, int, str, dict]]:
        """(start, end, identifier, captured) of the sentences that are known or speak of a license;
        others that stand between give the identifier ``""``."""
        lowered = text.lower()
        if not any(a in lowered for a in ANCHORS) and not any(a.search(lowered) for a in _WIDE):
            return []
        out = []
        for pieces in self._pieces(text):
            low = " ".join(p for _, _, p in pieces)
            known = self._known(pieces) if any(a in low for a in ANCHORS) else {}
            k = 0
            while k < len(pieces):
                if k in known:
                    to, name, got = known[k]
                else:
                    to = next((j for j in range(k + 1, len(pieces)) if j in known), len(pieces))
                    name, got = "unknown" if any(_SPEAKS.search(p) for _, _, p in pieces[k:to]) else "", {}
                out.append((pieces[k][0], pieces[to - 1][1], name, got))
                k = to
        return out

    def licenses(self, text: str) -> list[tuple[str, int, int]]:
        """(license, start, end) in order, ``unknown`` for sentences that no rule takes."""
        known = [p for p in self.identified(text) if p[2]]
        out, k = [], 0
        while k < len(known):
            if found := self.automaton.first(known, k, self.farthest):
                rule, after = found
                out.append((self._named(self.rules[rule].name, known[k:after]), known[k][0], known[after - 1][1]))
            else:
                after = k + 1
                out.append(("unknown", *known[k][:2]))
            k = after
        return out

    @staticmethod
    def _named(name: str, parts: list[tuple[int, int, str, dict]]) -> str:
        got: dict = {}
        for p in reversed(parts):
            got |= p[3]
        kind = got.get("kind", "")
        kind = {"lesser": "L", "affero": "A", "library": "L"}.get(kind, kind.upper())
        said = name.replace("{version}", got.get("version", "")).replace("{kind}", kind).replace("{expression}", got.get("expression", ""))
        return said.replace("-+", "+").rstrip("-")


def license_spans(sentences: dict[str, tuple[str, ...]] = SENTENCES, rules: tuple[LicenseRule, ...] = RULES):
    """A column function: text -> struct of parallel arrays licenses, starts, ends (code points)."""

    def make():
        scanner = LicenseScanner(sentences, rules)

        def one(text: str) -> tuple:
            found = scanner.licenses(text)
            return [x for x, _, _ in found], [a for _, a, _ in found], [e for _, _, e in found]

        return one

    return text_udf(make, "licenses array<string>, starts array<int>, ends array<int>")


def scan_licenses(docs: DataFrame, sentences: dict[str, tuple[str, ...]] = SENTENCES, rules: tuple[LicenseRule, ...] = RULES) -> DataFrame:
    """doc_id and one struct column ``found`` for every row of docs.

    A null or empty text has no license; repeated rows are scanned each; a text of any
    length is scanned whole; other columns of docs aren't read; an empty table gives an
    empty one.
    """
    return docs.select("doc_id", license_spans(sentences, rules)("text").alias("found"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    spans = F.transform(F.arrays_zip(F.col("found.licenses").alias("l"), F.col("found.starts").alias("s"), F.col("found.ends").alias("e")), lambda x: F.concat_ws(":", x["l"], x["s"].cast("string"), x["e"].cast("string")))
    return found.select("doc_id", F.size("found.licenses").cast("long").alias("n_licenses"), F.array_join(F.array_distinct("found.licenses"), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))
