"""Secret scans by one combined deterministic automaton.

All rules are compiled together (:mod:`.automaton`: subset construction, then
minimisation) into one transition array, and each text is scanned in one pass
over its UTF-8 bytes. A rule is a *head*, recognised by the automaton, and a
*tail* class that extends the match as far as it goes; a mirrored automaton,
run backwards from a hit, finds where the match starts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import compile_rules, mirrored, parse
from .base import sha256_hex, text_udf


@dataclass(frozen=True)
class Rule:
    """``head`` ends with the first character of the value; ``least`` counts the
    whole match, or only the value (``of_value``)."""

    kind: str
    head: str
    tail: str = ""
    least: int = 1
    of_value: bool = False
    any_case: bool = False


#: The rules whose spans every result has, in the order of their kinds.
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]", "[A-Za-z0-9+/_.=-]", 8, True, True),
    Rule("access", "AKIA[A-Z0-9]{12}", "[A-Z0-9]", 16),
    Rule("hex", "[0-9a-f]{32}", "[0-9a-f]", 32),
)
#: Published key formats that the method adds.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "[A-Za-z0-9]", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9]", "[A-Za-z0-9-]", 16),
    Rule("google", "AIza[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]", "[A-Za-z0-9]", 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{4}", "[A-Za-z0-9_.-]", 60),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        trees = [parse(r.head, r.any_case) for r in rules]
        self.forward = compile_rules(trees)
        self.backward = [compile_rules([mirrored(t)], anchored=True) for t in trees]
        self.tails = [frozenset(parse(r.tail)[1][0][1]) if r.tail else frozenset() for r in rules]

    def _start(self, k: int, data: bytes, end: int) -> int:
        """Leftmost place from which rule k's head ends at end."""
        a, s, i, best = self.backward[k], self.backward[k].start, end, end
        while i > 0 and s != a.dead:
            i -= 1
            s = a.moves[s + data[i]]
            if s >= a.first_hit:
                best = i
        return best

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, by start, then rule; per rule leftmost and apart."""
        data = text.encode("utf-8", "surrogatepass")
        moves, s, first, hits = self.forward.moves, self.forward.start, self.forward.first_hit, self.forward.hits
        free = [0] * len(self.rules)
        found = []
        for i, b in enumerate(data):
            s = moves[s + b]
            if s >= first:
                for k in hits[s]:
                    if i < free[k]:
                        continue
                    start = self._start(k, data, i + 1)
                    if start < free[k]:
                        continue
                    end, tail = i + 1, self.tails[k]
                    while end < len(data) and data[end] in tail:
                        end += 1
                    free[k] = end
                    if end - (i if self.rules[k].of_value else start) >= self.rules[k].least:
                        found.append((start, k, end))
        found.sort()
        if len(data) != len(text) and found:
            points = sorted({x for f in found for x in (f[0], f[2])})
            at, chars, of = 0, 0, {}
            for p in points:
                chars += len(data[at:p].decode("utf-8", "surrogatepass"))
                at, of[p] = p, chars
            found = [(of[a], k, of[e]) for a, k, e in found]
        return found


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    """Compiling takes seconds; a session does it once for each set of rules."""
    return Scanner(rules)


SCHEMA = "kinds array<string>, starts array<int>, ends array<int>"


def secret_spans(rules: tuple[Rule, ...] = BASE + MORE):
    """A column function: text -> struct of parallel arrays kinds, starts, ends (code points)."""
    scanner = compiled(rules)

    def make():
        def one(text: str) -> tuple:
            found = scanner.spans(text)
            return [rules[k].kind for _, k, _ in found], [a for a, _, _ in found], [e for _, _, e in found]

        return one

    return text_udf(make, SCHEMA)


def digest_columns(spans: Column, base: list[str]) -> list[Column]:
    """n_<kind> for each base kind, base_sha256 and spans, from a struct of span arrays."""
    joined = F.transform(
        F.arrays_zip(spans["kinds"].alias("k"), spans["starts"].alias("s"), spans["ends"].alias("e")),
        lambda x: F.struct(x["k"].alias("kind"), F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string")).alias("said")),
    )
    count = lambda kind: F.size(F.filter(spans["kinds"], lambda x: x == kind))
    said = lambda rows: F.array_join(F.transform(rows, lambda x: x["said"]), ",")
    return [
        *(count(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(said(F.filter(joined, lambda x: x["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        said(joined).alias("spans"),
    ]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and one struct column ``found`` of span arrays for every row of docs.

    A null or empty text has no spans; repeated rows are scanned each; a text of any
    length is scanned whole, in one pass; other columns of docs are not read, so
    clashing names don't matter; an empty table gives an empty one.
    """
    return docs.select("doc_id", secret_spans(rules)("text").alias("found"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``<KIND>``; overlapping spans become one, named by the first."""
    zipped = F.arrays_zip(spans["kinds"].alias("k"), spans["starts"].alias("s"), spans["ends"].alias("e"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, x):
        return F.when(
            x["s"] >= acc["at"],
            F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("<"), F.upper(x["k"]), F.lit(">")).alias("out"), x["e"].alias("at")),
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["e"]).alias("at")))

    done = F.aggregate(zipped, start, step)
    return F.when(F.size(spans["kinds"]) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .base import table

    kinds = [r.kind for r in BASE]
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *digest_columns(F.col("found"), kinds))


__all__ = ["BASE", "MORE", "Rule", "Scanner", "digest_columns", "op6_secret_scan", "redact", "scan_secrets", "secret_spans", "sha256_hex"]
