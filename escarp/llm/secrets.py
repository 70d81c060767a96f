"""Secret scans: fixed patterns, and character Markov models for what they miss.

Patterns give the base spans (assignments, access keys, hexadecimal runs). Further runs of key
characters are scored by two first-order Markov models over characters, one of random strings and
one of ordinary identifiers: the sum of log-likelihood ratios of the transitions decides. Both are
trained from labelled samples that the patterns label: the values of base spans are random strings,
identifiers outside of them are ordinary.

Everything is built-in functions; a text never leaves its row. Positions are code points, ends
exclusive. Matching is linear in the text. The model is a table of 95 x 95 numbers.

Defined results: NULL and empty texts have no spans; repeated rows and ids each keep their row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escarp.session import materialize, scratch_dir

# Kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Fragments that any assignment has in lower case; texts without one need no search.
ASSIGN_PARTS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}+"
HEX = "[0-9a-f]{16,}+"

#: Runs that the models judge (whole ones, so a search starts only where one begins), and identifiers
#: that train them.
RUN_LEAST = 12
RUN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RUN_LEAST},}}+"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{3,}+"
#: Documents of the training sample (expected number, by hash of the row).
SAMPLE_ROWS = 2000
#: Least log-likelihood ratio of a secret (0: likelier a random string), and weight of the character
#: frequencies in a transition: a character that is rare among identifiers says little about its
#: followers there.
LEAST_RATIO = 0.0
SMOOTHING = 100.0
#: Fits of the models: identifiers that one calls a secret do not train the next.
ROUNDS = 8

_CODES = 95
_BLOCK = 256


def _running(steps: str) -> str:
    """Sums of the elements before each element of an array of longs.

    Sums run inside blocks and over blocks: growing one list element by element would cost the
    square of its length.
    """
    start = "named_struct('s', 0L, 'a', CAST(array() AS array<bigint>))"
    step = "(acc, v) -> named_struct('s', acc.s + v, 'a', concat(acc.a, array(acc.s)))"
    blocks = f"transform(sequence(0, (size({steps}) - 1) div {_BLOCK}), b -> slice({steps}, b * {_BLOCK} + 1, {_BLOCK}))"
    sums = f"transform({blocks}, b -> aggregate(b, 0L, (x, y) -> x + y))"
    bases = f"aggregate({sums}, {start}, {step}, acc -> acc.a)"
    inner = f"aggregate(blk, {start}, {step}, acc -> acc.a)"
    return f"flatten(zip_with({blocks}, {bases}, (blk, base) -> transform({inner}, v -> base + v)))"


def _found(
    df: DataFrame, kind: str, pattern: str, gate: Column, group: int = 0, text: str = "text"
) -> DataFrame:
    """Column `kind`: array of (begin, end, value) of the matches in `text`, value being a group.

    The texts between the matches, by the same pattern, give the positions.
    """
    empty = F.expr("CAST(array() AS array<string>)")
    df = df.withColumn(
        "_match", F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)
    )
    some = F.size("_match") > 0
    df = df.withColumn("_between", F.when(some, F.split(text, pattern, -1)).otherwise(empty))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.col("_match")
    df = df.withColumn("_value", F.when(some, value).otherwise(empty))
    df = df.withColumn(
        "_step",
        F.expr("zip_with(_between, _match, (g, m) -> CAST(length(g) + coalesce(length(m), 0) AS bigint))"),
    )
    df = df.withColumn("_before", F.when(some, F.expr(_running("_step"))))
    spans = """
        transform(sequence(0, size(_match) - 1), i -> named_struct(
            'begin', _before[i] + length(_between[i]),
            'end', _before[i] + length(_between[i]) + length(_match[i]),
            'value', _value[i]))
    """
    none = "CAST(array() AS array<struct<begin:bigint,end:bigint,value:string>>)"
    df = df.withColumn(kind, F.when(some, F.expr(spans)).otherwise(F.expr(none)))
    return df.drop("_match", "_between", "_value", "_step", "_before")


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, assign, access, hex): the base spans of each text."""
    df = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    lower = F.lower("text")
    named = F.lit(False)
    for part in ASSIGN_PARTS:
        named = named | F.contains(lower, F.lit(part))
    df = _found(df, "assign", ASSIGN, named, group=1)
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= ASSIGN_LEAST))
    df = _found(df, "access", ACCESS, F.contains("text", F.lit("AKIA")))
    return _found(df, "hex", HEX, F.lit(True))


def _transitions(text: str) -> str:
    """Numbers of the character pairs of a text of printable ASCII characters."""
    codes = f"transform(split({text}, ''), c -> ascii(c) - 32)"
    return f"""
        transform(array({codes}), codes -> IF(size(codes) < 2, CAST(array() AS array<int>),
            transform(sequence(1, size(codes) - 1),
                i -> element_at(codes, i) * {_CODES} + element_at(codes, i + 1))))[0]
    """


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-likelihood ratio of each transition, random string against identifier.

    Fitted on the base spans and identifiers of a sample of about SAMPLE_ROWS documents, chosen by
    a hash of id and text. Secrets that no pattern finds are first taken for identifiers; those long
    enough to be judged leave the sample once a fit tells them apart.
    """
    rows = docs.count()
    part = min(1.0, SAMPLE_ROWS / max(rows, 1))
    lot = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("sample")), F.lit(1 << 20))
    sample = docs.filter(lot < max(1, math.ceil(part * (1 << 20))))
    spans = base_spans(sample, id_col, text_col)
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))
    words = [F.transform(kind, lambda s: s["value"]) for kind in KINDS[:3]]
    kinds = F.array(*[F.struct(F.lit(n + 1).alias("kind"), w.alias("words")) for n, w in enumerate(words)])
    labelled = spans.select(F.inline(kinds)).unionByName(
        spans.select(F.lit(0).alias("kind"), ordinary.alias("words"))
    )
    labelled = labelled.select("kind", F.explode("words").alias("word"))
    words = labelled.groupBy("kind", "word").count().withColumn("pairs", F.expr(_transitions("word")))
    words = materialize(words.drop("word"), f"{scratch_dir(docs.sparkSession)}/words")
    for _ in range(ROUNDS - 1):
        odd = f"kind = 0 AND size(pairs) >= {RUN_LEAST - 1} AND {_ratio('pairs', _fitted(words))} >= {LEAST_RATIO}"
        words = words.filter(f"NOT ({odd})")
    return _fitted(words)


def _fitted(words: DataFrame) -> list[float]:
    """Log-likelihood ratios from (kind, pairs, count), kind 0 being ordinary."""
    pairs = words.select("kind", "count", F.explode("pairs").alias("pair"))
    found = pairs.groupBy("kind", "pair").agg(F.sum("count").alias("n")).collect()  # at most 4 x 95 x 95 rows
    totals = [sum(row["n"] for row in found if row["kind"] == kind) for kind in range(len(KINDS))]
    # kinds of base spans weigh the same, however many there are of each
    share = sum(totals[1:]) / max(1, sum(total > 0 for total in totals[1:]))
    counts = [[0.0] * (_CODES * _CODES) for _ in range(2)]
    for row in found:
        kind = row["kind"]
        counts[min(kind, 1)][row["pair"]] += row["n"] * (share / totals[kind] if kind else 1)
    logs = []
    for table in counts:
        single = [sum(table[code::_CODES]) + 0.5 for code in range(_CODES)]
        rates = [n / sum(single) for n in single]
        out = []
        for first in range(_CODES):
            line = table[first * _CODES : (first + 1) * _CODES]
            total = sum(line) + SMOOTHING
            out += [math.log((n + SMOOTHING * r) / total) for n, r in zip(line, rates, strict=True)]
        logs.append(out)
    return [a - b for a, b in zip(logs[1], logs[0], strict=True)]


def _ratio(pairs: str, ratios: list[float]) -> str:
    """Sum of the ratios of an array of transitions."""
    table = ",".join(f"{ratio:.6g}" for ratio in ratios)
    return f"""
        aggregate({pairs}, 0D,
            (acc, pair) -> acc + element_at(CAST(split('{table}', ',') AS array<double>), pair + 1))
    """


def _blanked(pattern: str, group: int = 0, least: int = 0) -> Column:
    """`_rest` with blanks of the same length for the matches whose group has `least` characters."""
    whole = F.regexp_extract_all("_rest", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("_rest", F.lit(pattern), F.lit(group)) if group else whole
    blank = F.transform(
        F.arrays_zip(whole.alias("all"), value.alias("value")),
        lambda m: F.when(F.length(m["value"]) >= least, F.repeat(F.lit(" "), F.length(m["all"]))).otherwise(
            m["all"]
        ),
    )
    between = F.split("_rest", pattern, -1)
    return F.array_join(F.zip_with(between, blank, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, assign, access, hex, markov): all spans of each text.

    Runs of key characters are judged where base spans leave them: base spans are blanked out first,
    so what a run has on either side of one is a run by itself. A run is a markov span if its ratio
    reaches LEAST_RATIO.
    """
    ratio = _ratio(_transitions("s.value"), train(docs, id_col, text_col))
    spans = base_spans(docs, id_col, text_col)
    spans = spans.withColumn("_rest", F.col("text"))
    for kind, pattern, group, least in (
        ("assign", ASSIGN, 1, ASSIGN_LEAST),
        ("access", ACCESS, 0, 0),
        ("hex", HEX, 0, 0),
    ):
        blanked = F.when(F.size(kind) > 0, _blanked(pattern, group, least)).otherwise(F.col("_rest"))
        spans = spans.withColumn("_rest", blanked)
    spans = _found(spans, "runs", RUN, F.lit(True), text="_rest")
    spans = spans.withColumn("_base", F.concat(*KINDS[:3]))
    # a base span that another kind cuts short in `_rest` may leave a rest of its own
    free = "NOT exists(_base, b -> b.begin < s.end AND s.begin < b.end)"
    judged = F.expr(f"filter(runs, s -> {ratio} >= {LEAST_RATIO} AND {free})")
    none = F.expr("filter(runs, s -> false)")
    return spans.withColumn("markov", F.when(F.size("runs") > 0, judged).otherwise(none)).drop(
        "runs", "_base", "_rest"
    )


def _joined(kinds: tuple[str, ...]) -> Column:
    """kind:begin:end of all spans by begin, then kind, comma-joined."""

    def named(number: int, kind: str) -> Column:
        def one(span: Column) -> Column:
            text = F.concat_ws(":", F.lit(kind), span["begin"], span["end"])
            return F.struct(span["begin"].alias("begin"), F.lit(number).alias("number"), text.alias("text"))

        return F.transform(kind, one)

    parts = [named(number, kind) for number, kind in enumerate(kinds)]
    ordered = F.array_sort(F.concat(*parts))
    return F.array_join(F.transform(ordered, lambda s: s["text"]), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of base spans by kind, digest of the base spans, all spans."""
    return scan(docs, id_col, text_col).select(
        F.col("id").alias(id_col),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        _joined(KINDS).alias("spans"),
    )
