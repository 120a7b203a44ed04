"""Secret scans: patterns, and a randomness test battery for other tokens.

All of it is SQL functions. Long tokens without white space are candidates.
An encoding is inferred for each (hex, base32, base64), and its characters
are tested as digits of that encoding: chi-squared uniformity over the
alphabet, the runs test about the middle digit, and lag-one serial
correlation.

The battery decides in two directions, each under false-discovery control of
its own by length class, since short tokens say little and come by chance far
more often than long ones. The least of the three p-values of randomness,
times three, finds tokens that are no random strings; these are dropped. What
stays must also be found to be no text: the same three statistics are held
against what prose gives (repeated characters, runs of character classes,
correlation), and their sum has a p-value. A token is a span if text is
rejected and randomness is not. The controls need only counts of p-values in
bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridweave.llm.shared import saved

#: The kinds in the order of the contract: pattern, group that must be so long, least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Patterns with the same matches for kinds whose least length can stand in the pattern.
_SEARCH = {"assign": KINDS["assign"][0], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
HEX, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: The share of false discoveries allowed in either direction.
FALSE_SHARE = 0.01
#: Bins of -log10(p), in quarters.
BINS = 80
#: In prose: chance that two characters agree, that three do, that the class changes, and the serial correlation of digits about the middle.
_AGREE, _AGREE3, _CHANGE, _SERIAL = 0.066, 0.0062, 0.15, 0.36


def _sql(text: str) -> str:
    """A literal for F.expr."""
    return "r'" + text.replace("'", "' '") + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, group: int, token: bool = False) -> Column:
    """Of each match of a pattern the lengths of what stands before it, its own and its group's, and with ``token`` its text.

    What split leaves stands before, between and after the matches.
    """
    p = _sql(pattern)
    kept = "m['1']" if token else "cast(null as string)"
    each = f"named_struct('before', length(m['0']), 'size', length(m['1']), 'grouped', length(m['2']), 'token', {kept})"
    return F.expr(
        f"""case when {text} rlike {p} then transform(
          arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})), m -> {each}) end"""
    )


def _placed(found: DataFrame) -> DataFrame:
    """row, kind (its place in KINDS; candidates last), start, end, token, free of all matches that are long enough.

    Places are running sums of lengths over a text's matches. A candidate is
    free if no base span overlaps it: none that starts before it goes on
    beyond its start, and none starts within it. Both come from windows over
    a text's spans in order, so the work is that of sorting them.
    """
    least = [*(n for _, _, n in KINDS.values()), 20]
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("least"), F.col(c).alias("m")) for k, (n, c) in enumerate(zip(least, [*KINDS, "candidates"], strict=True))))
    kinds = found.select("row", F.explode(F.filter(each, lambda x: x["m"].isNotNull())).alias("k"))
    flat = kinds.select("row", "k.kind", "k.least", F.posexplode("k.m").alias("place", "m")).select("row", "kind", "least", "place", "m.*").repartition("row")
    end = F.sum(F.col("before") + F.coalesce("size", F.lit(0))).over(W.partitionBy("row", "kind").orderBy("place"))
    spans = flat.withColumn("end", end.cast("long")).where("size is not null and grouped >= least").withColumn("start", F.col("end") - F.col("size"))
    ordered, base = W.partitionBy("row").orderBy("start"), F.col("kind") < len(KINDS)
    before = F.max(F.when(base, F.col("end"))).over(ordered)
    after = F.min(F.when(base, F.col("start"))).over(W.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(W.unboundedPreceding, W.currentRow))
    inside = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    return spans.select("row", "kind", "start", "end", "token", (~base & ~inside).alias("free"))


def upper_tail(z: Column) -> Column:
    """The chance that a standard normal variable exceeds z (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """p-values of tokens (column token): p_chi, p_runs, p_serial of randomness, p_random of all three, and p_text of prose."""
    x = tokens.withColumn("_t", F.regexp_replace("token", "=+$", "")).withColumn("_n", F.length("_t").cast("double"))
    code = F.when(F.lower("_t").rlike("^[0-9a-f]+$") & ((F.lower("_t") == F.col("_t")) | (F.upper("_t") == F.col("_t"))), "hex")
    x = x.withColumn("encoding", code.when(F.col("_t").rlike("^[A-Z2-7]+$"), "base32").otherwise("base64"))
    hexed, thirty = F.col("encoding") == "hex", F.col("encoding") == "base32"
    x = x.withColumns(
        {
            "_abc": F.when(hexed, HEX).when(thirty, BASE32).otherwise(BASE64),
            "_d": F.when(hexed, F.lower("_t")).otherwise(F.translate("_t", "-_", "+/")),
        }
    ).withColumn("_k", F.length("_abc").cast("double"))
    x = x.withColumns(
        {
            "_squares": F.expr("aggregate(split(_abc, ''), 0D, (s, c) -> s + case when c = '' then 0D else power(_n - length(replace(_d, c, '')), 2) end)"),
            "_half": F.expr("translate(_d, _abc, concat(repeat('0', int(_k / 2)), repeat('1', int(_k / 2))))"),
            "_v": F.expr("transform(slice(split(_d, ''), 1, int(_n)), c -> locate(c, _abc) - (_k + 1) / 2)"),
        }
    )
    n, k = F.col("_n"), F.col("_k")
    chi = k / n * F.col("_squares") - n
    cube = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    ones = F.length(F.regexp_replace("_half", "0", "")).cast("double")
    zeros, runs = n - ones, F.regexp_count("_half", F.lit("0+|1+"))
    mean = 2 * ones * zeros / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    x = x.withColumns(
        {
            "_lag": F.expr("aggregate(sequence(1, int(_n) - 1), 0D, (s, i) -> s + _v[i] * _v[i - 1])"),
            "_sq": F.expr("aggregate(_v, 0D, (s, c) -> s + c * c)"),
            "_class": F.expr("regexp_count(_t, '[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+') - 1"),
            "_same": F.expr("aggregate(array_distinct(split(_t, '')), 0D, (s, c) -> s + case when c = '' then 0D else (_n - length(replace(_t, c, ''))) * (_n - length(replace(_t, c, '')) - 1) end)"),
        }
    )
    changes = (F.col("_class") - _CHANGE * (n - 1)) / F.sqrt(_CHANGE * (1 - _CHANGE) * (n - 1))
    agree = (F.col("_same") / (n * (n - 1)) - _AGREE) / F.sqrt(2 * _AGREE * (1 - _AGREE) / (n * (n - 1)) + 4 * (_AGREE3 - _AGREE**2) / n)
    ratio = F.when(F.col("_sq") > 0, F.col("_lag") / F.col("_sq")).otherwise(F.lit(99.0))
    less = F.greatest((_SERIAL - ratio) * F.sqrt(n), F.lit(-99.0))
    found = x.withColumns(
        {
            "p_chi": upper_tail(cube),
            "p_runs": 2 * upper_tail(F.abs(runs - mean) / spread),
            "p_serial": 2 * upper_tail(F.abs(ratio) * F.sqrt(n)),
            "p_text": upper_tail((changes - agree + less) / 3**0.5),
        }
    )
    found = found.withColumn("p_random", F.least(3 * F.least("p_chi", "p_runs", "p_serial"), F.lit(1.0)))
    return found.select(*tokens.columns, "encoding", "p_chi", "p_runs", "p_serial", "p_random", "p_text")


def _bin(p: str) -> Column:
    """The bin of -log10(p), in quarters."""
    return F.least(F.floor(-4 * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(BINS)).cast("int")


def discoveries(tested: DataFrame, column: str, share: float = FALSE_SHARE) -> Column:
    """Whether a row's bin (column) of -log10(p) is a discovery in its length class (klass).

    Benjamini and Hochberg's rule on binned p-values, taken at the upper end
    of their bin. There are as many classes as bits in the longest length.
    """
    counts = tested.groupBy("klass", F.col(column).alias("bin")).agg(F.count("*").alias("n"))
    down = W.partitionBy("klass").orderBy(F.col("bin").desc())
    ranked = counts.withColumns({"rank": F.sum("n").over(down), "all": F.sum("n").over(W.partitionBy("klass"))})
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 4) <= share * F.col("rank") / F.col("all"))
    found = F.lit(False)
    for r in passed.groupBy("klass").agg(F.min("bin").alias("bin")).collect():
        found = F.when(F.col("klass") == r["klass"], F.col(column) >= r["bin"]).otherwise(found)
    return found


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of df.

    Null and empty texts have no spans, and base_sha256 of an empty string.
    Null ids come back as null, repeated rows get repeated answers, an empty
    table no rows. Spans of the base kinds stay whatever the battery says; a
    random token that overlaps one of them is not added. Work grows with a
    text's matches in proportion (they are sorted), so a very long list of
    hashes is one text like others.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = docs.select(
        "doc_id",
        *(_matches("text", _SEARCH[k], group).alias(k) for k, (_, group, _least) in KINDS.items()),
        _matches("text", CANDIDATE, 0, True).alias("candidates"),
        F.monotonically_increasing_id().alias("row"),
    )
    found = saved(found, "secrets")
    placed = saved(_placed(found), "placed")

    tested = battery(placed.where("free").select("row", "start", "end", "token")).select(
        "row", "start", "end",
        F.length(F.bin(F.col("end") - F.col("start"))).alias("klass"),
        _bin("p_text").alias("no_text"),
        _bin("p_random").alias("no_random"),
    )
    tested = saved(tested, "tested")
    secret = discoveries(tested, "no_text", share) & ~discoveries(tested, "no_random", share)
    added = tested.where(secret).select("row", "start", F.lit(len(KINDS)).alias("kind"), "end").distinct()

    spans = placed.where(F.col("kind") < len(KINDS)).select("row", "start", "kind", "end").unionByName(added)
    of_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    names = "array(" + ", ".join(f"'{k}'" for k in [*KINDS, "random"]) + ")"
    joined = lambda which: f"array_join(transform({which}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)), ',')"
    x = found.select("doc_id", "row").join(of_row, "row", "left").withColumn("s", F.expr("coalesce(s, array())"))
    many = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    return x.select(
        "doc_id",
        *(many(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(F.expr(joined(f"filter(s, s -> s.kind < {len(KINDS)})")), 256).alias("base_sha256"),
        F.expr(joined("s")).alias("spans"),
        many(len(KINDS)).alias("n_random"),
    )
