"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models over characters, one of random strings, one of ordinary identifiers, are counted from labelled
samples. A candidate token is a secret if its mean log-likelihood ratio per transition is at least a threshold, which the random
samples set by length: their mean, less some deviations of a mean of so many transitions. All of it, training included, is
DataFrame functions; the model is one literal array of fixed size.

Spans of all matches come from cutting the text at the pattern: the pieces between matches and the matches alternate, so
running sums of their lengths are the positions. The sums are taken in blocks, and what a lambda reads is bound once, so a
text of a hundred thousand matches takes seconds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the models; any other is character 0.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SYMBOLS = len(ALPHABET) + 1
SMOOTHING = 0.5
#: Least ratio at any length, itself and as a share of the random samples' mean, and deviations below that mean that still count.
LEAST_RATIO, LEAST_SHARE, DEVIATIONS = 0.35, 0.32, 3.0
#: Tokens that are looked at: of LEAST_LENGTH characters or more, with a letter, as numbers alone are cards and counts.
LEAST_LENGTH = 16
CANDIDATE = rf"(?=[A-Za-z0-9+/_.-]{{{LEAST_LENGTH}}})[A-Za-z0-9+/_-]++(?:\.[A-Za-z0-9+/_-]++)*+"
TRAINING_ROWS = 4000
#: Elements of a block of running sums.
BLOCK = 128

ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Kinds as listed: pattern, and whether its group 1 must have 8 characters (else the pattern holds the least length:
#: a run that is too short fails from each of its characters on, so the length may stand in the pattern).
KINDS = {"assign": (ASSIGN, True), "access": (r"AKIA[A-Z0-9]{12,}", False), "hex": (r"[0-9a-f]{32,}", False)}

# Words of which ordinary identifiers are made.
PARTS = "get set user name file path index value count size list map node edge data time date start end read write open close load save parse format string number buffer stream client server request response handler manager service config option default parent child first last next previous update delete insert select create table column row key item cache queue worker thread process message event listener button window view model controller test result error exception version module package import export account order customer product price total amount address city country language document section article chapter page line word letter".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body, or a lambda in it, reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column, depth: int = 2) -> Column:
    """The merge of all elements before each, of an array of longs: in blocks of ``BLOCK`` elements, their totals in blocks again, so
    that a few million elements cost a few million steps."""
    state = F.struct(zero.alias("upto"), F.array().cast("array<bigint>").alias("before"))
    one = lambda block: F.aggregate(block, state, lambda s, x: F.struct(merge(s["upto"], x).alias("upto"), F.array_append(s["before"], s["upto"]).alias("before")))
    if not depth:
        return one(values)["before"]

    def joined(blocks: Column) -> Column:
        heads = running(F.transform(blocks, lambda b: b["upto"]), merge, zero, depth - 1)
        return let(heads, lambda h: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["before"], lambda x: merge(F.get(h, i), x)))))

    def cut(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda i: one(F.slice(own, i, F.lit(BLOCK)))), joined)

    return let(values, cut)


SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string,text:string>>"


def _matched(kind: str, pattern: str, valued: bool) -> Column:
    """Array of (start, ord, end, kind, text), code points, of all matches of ``pattern`` in ``text_``. The pieces between matches and
    the matches alternate; each is cut out once, and running sums of their lengths are the positions."""
    order = [*KINDS, "markov"].index(kind)
    found = [F.regexp_extract_all("text_", F.lit(pattern), F.lit(g)) for g in ((0, 1) if valued else (0,))]
    pieces = F.arrays_zip(F.split("text_", pattern, -1).alias("between"), *[c.alias(n) for c, n in zip(found, ("all", "value"), strict=False)])

    def spans(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: (F.length(p["between"]) + F.coalesce(F.length(p["all"]), F.lit(0))).cast("long"))

        def placed(before: Column) -> Column:
            start = lambda p, i: F.get(before, i) + F.length(p["between"])
            span = lambda p, i: F.struct(start(p, i).alias("start"), F.lit(order).alias("ord"), (start(p, i) + F.length(p["all"])).alias("end"), F.lit(kind).alias("kind"), p["value" if valued else "all"].alias("text"))
            return F.transform(F.filter(parts, lambda p: p["all"].isNotNull()), span)

        return let(running(lengths, lambda a, b: a + b, F.lit(0).cast("long")), placed)

    out = F.when(F.col("text_").rlike(pattern), let(pieces, spans)).otherwise(F.array()).cast(SPAN)
    return F.filter(out, lambda s: F.length(s["text"]) >= 8) if valued else out


def _free(merged: Column) -> Column:
    """The candidates among spans in order that touch no base span: the greatest end of base spans before and the least start after
    are running values, so many spans are no pairs."""
    own = F.lit(len(KINDS))
    far = F.lit(1 << 62)
    ends = running(F.transform(merged, lambda s: F.when(s["ord"] < own, s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))
    starts = running(F.transform(F.reverse(merged), lambda s: F.when(s["ord"] < own, s["start"]).otherwise(far)), lambda a, b: F.least(a, b), far)
    n = F.size(merged)
    return let(ends, lambda before: let(starts, lambda after: F.filter(merged, lambda s, i: (s["ord"] == own) & (F.get(before, i) <= s["start"]) & (F.get(after, n - 1 - i) >= s["end"]))))


def labelled_samples(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, random): digests as hex, base 64 and upper-case keys, and identifiers of two to five parts in five styles,
    each drawn by hashes of the row number. Callers may pass samples of their own to :func:`train` instead."""
    ids = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    plain = F.regexp_replace(F.base64(F.unhex(digest)), "[=\\s]", "")
    random = F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, plain).otherwise(F.upper(F.regexp_replace(plain, "[+/]", "")))
    parts = F.array(*map(F.lit, PARTS))
    part = [F.element_at(parts, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))) + 1).cast("int")) for k in range(5)]
    n = (F.pmod(F.xxhash64(F.col("id"), F.lit("n")), F.lit(4)) + 2).cast("int")
    own = F.slice(F.array(*part), F.lit(1), n)
    tail = F.when(F.col("id") % 4 == 0, F.pmod(F.xxhash64(F.col("id"), F.lit("t")), F.lit(1000)).cast("string")).otherwise(F.lit(""))
    camel = F.array_join(F.transform(own, lambda w: F.initcap(w)), "")
    style = F.col("id") % 5
    name = F.when(style == 0, F.array_join(own, "_")).when(style == 1, camel).when(style == 2, F.array_join(own, "-")).when(style == 3, F.array_join(own, "/")).otherwise(F.array_join(own, ""))
    name = F.when(F.col("id") % 7 == 0, F.upper(F.array_join(own, "_"))).otherwise(name)
    return ids.select(random.alias("text"), F.lit(True).alias("random")).union(ids.select(F.concat(name, tail).alias("text"), F.lit(False).alias("random")))


class Ratios(list):
    """Ratios of transitions, and their mean and deviation over those of the random samples."""

    mean = deviation = 0.0


def train(samples: DataFrame) -> Ratios:
    """Log-likelihood ratio (random against ordinary) of each transition, ``SYMBOLS`` x ``SYMBOLS``, from samples
    (text, random). Null texts and labels are left out. The driver gets counts of transitions only."""
    codes = F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = samples.where("text is not null and random is not null").select("random", codes.alias("c"))
    at = F.when(F.size("c") > 1, F.sequence(F.lit(1), F.size("c") - 1)).otherwise(F.array().cast("array<int>"))
    pairs = pairs.select("random", F.explode(F.transform(at, lambda i: F.element_at("c", i) * SYMBOLS + F.element_at("c", i + 1))).alias("pair"))
    counts = {(r.random, r.pair): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}
    out, logs = Ratios(), {}
    for kind in (True, False):
        for a in range(SYMBOLS):
            row = [counts.get((kind, a * SYMBOLS + b), 0) + SMOOTHING for b in range(SYMBOLS)]
            total = sum(row)
            for b in range(SYMBOLS):
                logs[kind, a, b] = math.log(row[b] / total)
    for a in range(SYMBOLS):
        out += [logs[True, a, b] - logs[False, a, b] for b in range(SYMBOLS)]
    own = [(out[pair], n) for (random, pair), n in counts.items() if random]
    if total := sum(n for _, n in own):
        out.mean = sum(x * n for x, n in own) / total
        out.deviation = math.sqrt(sum((x - out.mean) ** 2 * n for x, n in own) / total)
    return out


def threshold(token: Column, ratios: Ratios, least_ratio: float = LEAST_RATIO) -> Column:
    """The least mean ratio of a secret as long as ``token``."""
    return F.greatest(F.lit(max(least_ratio, LEAST_SHARE * ratios.mean)), F.lit(ratios.mean) - DEVIATIONS * ratios.deviation / F.sqrt(F.greatest(F.length(token) - 1, F.lit(1))))


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio over the transitions of a token of two characters or more. The empty string that
    splitting leaves at no place but the end is cut off."""
    table = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in ratios) + "]"), "array<double>")
    codes = F.transform(F.slice(F.split(token, ""), F.lit(1), F.length(token)), lambda c: F.instr(F.lit(ALPHABET), c))
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    step = lambda s, c: F.struct((s["sum"] + F.when(s["last"] < 0, F.lit(0.0)).otherwise(F.element_at(table, s["last"] * SYMBOLS + c + 1))).alias("sum"), c.alias("last"))
    return F.aggregate(codes, state, step, lambda s: s["sum"]) / (F.length(token) - 1)


def scan(docs: DataFrame, ratios: Ratios, least_ratio: float = LEAST_RATIO, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, base and found, each an array of (start, ord, end, kind, text) in order; base holds the
    pattern spans, found the ones that the models add: candidate tokens with a letter that overlap no base span.

    Null texts count as empty. Positions are code points, ends exclusive. Repeated rows are each scanned; null ids pass
    through; other columns are ignored; an empty table gives no rows.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    spans = {kind: _matched(kind, pattern, valued) for kind, (pattern, valued) in KINDS.items()} | {"markov": _matched("markov", CANDIDATE, False)}
    df = df.select("doc_id", F.array_sort(F.concat(*[spans[k] for k in KINDS])).alias("base"), F.filter(spans["markov"], lambda m: (F.length(m["text"]) >= LEAST_LENGTH) & m["text"].rlike("[A-Za-z]")).alias("markov"))
    free = F.when(F.size("markov") > 0, let(F.array_sort(F.concat("base", "markov")), _free)).otherwise(F.array().cast(SPAN))
    found = F.filter(free, lambda m: mean_ratio(m["text"], ratios) >= threshold(m["text"], ratios, least_ratio))
    return df.select("doc_id", "base", found.alias("found"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    every = F.array_sort(F.concat("base", "found"))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"), F.size("found").cast("long").alias("n_markov"))
