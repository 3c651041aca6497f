"""Secret scan with a battery of randomness tests, in DataFrame functions only.

Base spans follow three fixed patterns. Beside them, every run of ``LEAST`` or more characters of an encoding alphabet is a
candidate. Its encoding is inferred (hex, base32, base62, base64), and three tests ask whether it looks like uniform draws from
that alphabet: chi-squared over the symbols, the number of runs of the upper and lower half of the alphabet, and the lag-one
correlation of symbol values. The least of the three p-values, times three, is the candidate's.

A text-like candidate is discarded by rejecting uniformity. Discarding a true secret is the error to control, so rejections are
made by Benjamini-Hochberg at ``ALPHA`` within each stratum of encoding and length, over all candidates of the corpus; p-values
are counted in ``BINS`` logarithmic bins first, so the procedure sees a bounded table. What is not rejected, and is mixed enough
(letters and digits), is a secret.

Null texts count as empty. Repeated rows are scanned each on their own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.base import cut_lineage

KINDS = ("assign", "access", "hex")
# Patterns of the base kinds (key letters in either case) and of candidates.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
# The alphabets, smallest first; a candidate gets the first that holds all its characters.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
ALPHA, BINS = 0.05, 400


def spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost matches without overlap as (kind, start, stop, word), code points, stop exclusive.

    Texts between matches come from ``split``, the matches from ``regexp_extract_all``; positions are running sums of lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    step = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    empty = F.array().cast("array<struct<kind:string,start:int,stop:int,word:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        stop = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), stop.alias("stop"), x["m"].alias("word"))
        return F.struct(stop.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(found))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(step, start, add, lambda acc: acc["out"])).otherwise(empty)


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the rational approximation of Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def encoding(word: Column) -> Column:
    out = F.lit("base64")
    for name in reversed([n for n in ALPHABETS if n != "base64"]):
        out = F.when(F.length(F.translate(word, ALPHABETS[name], "")) == 0, name).otherwise(out)
    return out


def battery(found: DataFrame) -> DataFrame:
    """Add ``encoding``, ``p_chi``, ``p_runs``, ``p_serial`` and ``p`` to rows with ``word``."""
    alphabet = F.create_map(*[x for k, v in ALPHABETS.items() for x in (F.lit(k), F.lit(v))])
    rows = found.withColumn("encoding", encoding(F.col("word"))).withColumn("alphabet", alphabet[F.col("encoding")])
    rows = rows.withColumn("values", F.expr("transform(split(word, ''), c -> cast(locate(c, alphabet) - 1 as double))"))
    rows = rows.withColumns({"n": F.size("values").cast("double"), "k": F.length("alphabet").cast("double")})
    rows = rows.withColumn("squares", F.expr("aggregate(array_distinct(values), 0D, (a, v) -> a + power(size(filter(values, x -> x = v)), 2))"))
    rows = rows.withColumns({
        "high": F.expr("cast(size(filter(values, v -> v >= k / 2)) as double)"),
        "runs": F.expr("1D + aggregate(sequence(1, size(values) - 1), 0D, (a, i) -> a + if((values[i] >= k / 2) <> (values[i - 1] >= k / 2), 1, 0))"),
        "mean": F.expr("aggregate(values, 0D, (a, v) -> a + v) / n"),
    })
    rows = rows.withColumns({
        "spread": F.expr("aggregate(values, 0D, (a, v) -> a + (v - mean) * (v - mean))"),
        "lagged": F.expr("aggregate(sequence(1, size(values) - 1), 0D, (a, i) -> a + (values[i] - mean) * (values[i - 1] - mean))"),
    })
    n, k, high = F.col("n"), F.col("k"), F.col("high")
    # Two-sided: text is too uneven, a counted-up alphabet too even.
    chi = F.col("squares") * k / n - n
    chi_z = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    low = n - high
    expected = 1 + 2 * high * low / n
    variance = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
    runs_z = F.when(variance > 0, (F.col("runs") - expected) / F.sqrt(variance)).otherwise(6.0)
    serial_z = F.when(F.col("spread") > 0, (F.col("lagged") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(6.0)
    two = lambda z: 2 * _normal_tail(F.abs(z))
    rows = rows.withColumns({"p_chi": two(chi_z), "p_runs": two(runs_z), "p_serial": two(serial_z)})
    return rows.withColumn("p", F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_serial"))).drop("alphabet", "values", "squares", "high", "runs", "mean", "spread", "lagged", "k")


def stratum() -> Column:
    return F.concat_ws("-", F.col("encoding"), F.least(F.floor(F.log2("n") * 2), F.lit(20)).cast("string"))


def p_bin(bins: int = BINS) -> Column:
    return F.least(F.floor(-20 * F.log10(F.greatest("p", F.lit(1e-300)))), F.lit(bins - 1)).cast("int")


def cuts(tested: DataFrame, alpha: float = ALPHA, bins: int = BINS) -> DataFrame:
    """``stratum``, ``cut``: the largest bin of p-values that Benjamini-Hochberg rejects in each stratum, as its lowest bin; ``bins`` if none.

    Bin b holds p in (10^-(b+1)/20, 10^-b/20]; the upper edge stands for all of a bin, so control is on the safe side.
    """
    counted = tested.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    table = counted.groupBy("stratum").agg(F.collect_list(F.struct("bin", "n")).alias("bins"), F.sum("n").alias("m"))  # at most `bins` entries
    upto = "aggregate(filter(bins, y -> y.bin >= x.bin), 0L, (a, y) -> a + y.n)"
    passing = F.expr(f"filter(bins, x -> power(10D, -x.bin / 20D) <= {alpha} * {upto} / m)")
    return table.select("stratum", F.coalesce(F.array_min(F.transform(passing, lambda x: x["bin"])), F.lit(bins)).alias("cut"))


def find(docs: DataFrame, *keep: str, alpha: float = ALPHA) -> DataFrame:
    """``keep`` with ``base`` and ``spans``: arrays of (kind, start, stop), by start, then kind as listed.

    ``spans`` adds the candidates taken as secrets (kind ``random``) that no base span overlaps. What the patterns found is
    written to the shared folder with a number for each row; only candidates move from there on, never texts.
    """
    # The text is a column of its own, so that no expression over it is repeated; kept columns go by number, whatever their names.
    asked, keep = keep, tuple(f"_{i}" for i in range(len(keep)))
    kept = [docs[f"`{c}`"].alias(n) for c, n in zip(asked, keep, strict=True)]
    rows = docs.select(*kept, F.monotonically_increasing_id().alias("row_number"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    assign = F.filter(spans(F.col("text"), ASSIGN, "assign"), lambda s: F.length(F.regexp_replace(s["word"], ASSIGN_VALUE, "")) >= 6)
    names = ("assign", "access", "hex", "more")
    found = (assign, spans(F.col("text"), ACCESS, "access"), spans(F.col("text"), HEX, "hex"), spans(F.col("text"), CANDIDATE, "random"))
    rows = rows.select(*keep, "row_number", *[c.alias(n) for c, n in zip(found, names, strict=True)])
    base = F.concat("assign", "access", "hex")
    mixed = lambda s: s["word"].rlike("[0-9]") & s["word"].rlike("[A-Za-z]")
    clear = lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    more = F.filter("more", lambda s: mixed(s) & clear(s))
    rows = cut_lineage(rows.select(*keep, "row_number", base.alias("base"), more.alias("more")))

    tested = battery(rows.select("row_number", F.inline("more")))
    tested = tested.withColumns({"stratum": stratum(), "bin": p_bin(BINS)})
    # At most encodings x lengths rows: 5 x 21.
    judged = tested.join(F.broadcast(cuts(tested, alpha)), "stratum").where(F.col("bin") < F.col("cut"))
    secrets = judged.groupBy("row_number").agg(F.collect_list(F.struct("kind", "start", "stop", "word")).alias("secrets"))
    rank = F.create_map(*[x for i, k in enumerate((*KINDS, "random")) for x in (F.lit(k), F.lit(i))])

    def ordered(array: Column) -> Column:
        keyed = F.transform(array, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    none = F.array().cast(rows.schema["base"].dataType)
    full = rows.join(secrets, "row_number", "left")
    spanned = full.select(*keep, ordered(F.col("base")).alias("base"), ordered(F.concat("base", F.coalesce("secrets", none))).alias("spans"))
    return spanned.toDF(*asked, "base", "spans")
