"""Quality rules judged by host, in DataFrame functions only.

Each document gets counts and a list of failed rules. The failures are summed by host (the
``source`` column). A host's rate of each rule is shrunk towards the rates of all hosts by
a beta prior whose two parameters are fitted to these rates by their mean and variance,
so that a host of few documents is not judged by chance. A host where the shrunk rate of
any rule reaches ``host_rate`` is rejected with all its documents; elsewhere each document
is judged by its own rules.

The counts are written once without the texts; the sums by host are partial aggregates, so
a host with a third of all rows is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.llm.common import WHITE, did, free_name, keyed, quoted, sig, text_of, without, words_of
from flightlens.session import materialize

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["short", "repeated", "symbols", "word_length", "dup_lines"]


def repeat_words(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds ``n_words`` and ``out``: the words that lie in a window of three words found twice or more.

    Windows are told apart by 64-bit hashes within their document. Hashes that occur twice
    are found by sorting; only texts that have some sort (hash, place) pairs as well, so long
    texts take n log n steps. Places p1 < p2 < ... of repeated windows cover
    3 + min(3, p2 - p1) + min(3, p3 - p2) + ... words.
    """
    w, h, s, p = (free_name(df, x) for x in ("w", "h", "s", "p"))
    no = F.lit(False)

    def both(a, b):
        return F.xxhash64(a, b)

    def ahead(array: str) -> Column:
        """Each element's successor; null for the last, once zipped."""
        return F.slice(array, 2, F.greatest(F.size(array), F.lit(1)))

    df = df.withColumn(w, words_of(text))
    df = df.withColumns({"n_words": F.size(w).cast("long"), h: F.transform(w, lambda x: F.xxhash64(x))}).drop(w)
    n = F.greatest(F.size(h) - 2, F.lit(0))
    df = df.withColumn(h, F.zip_with(F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), both), F.slice(h, 3, n), both))

    df = df.withColumn(s, F.sort_array(h))
    twice = F.exists(F.zip_with(s, ahead(s), lambda a, b: a == b), lambda x: x)
    places = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(p, F.when(F.coalesce(twice, no), places)).drop(s, h)

    # A place stays if the hash before or after it, in order of hashes, is the same.
    like_next = F.zip_with(p, ahead(p), lambda a, b: F.struct(a.alias("at"), F.coalesce(a["h"] == b["h"], no).alias("same")))
    behind = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(p, 1, F.size(p) - 1))
    repeated = F.zip_with(like_next, behind, lambda a, b: F.when(a["same"] | F.coalesce(a["at"]["h"] == b["h"], no), a["at"]["i"]))
    df = df.withColumn(p, F.sort_array(F.array_compact(repeated)))

    covered = F.zip_with(p, ahead(p), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    zero = F.lit(0).cast("long")
    return df.withColumn(out, F.coalesce(F.aggregate(covered, zero, lambda acc, x: acc + x), zero)).drop(p)


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """(did, sig, host) with the counts and one boolean per rule, for every row."""
    text = text_of("t")
    df = docs.select(did().alias("did"), sig().alias("sig"), F.col("source").alias("host"), F.col("text").alias("t"))
    df = df.withColumns(
        {
            "word_chars": F.length(without(text, WHITE)).cast("long"),
            "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
            "n_dup_lines": dup_lines(text),
            "n_lines": (F.length(text) - F.length(without(text, "\n")) + 1).cast("long"),
        }
    )
    df = repeat_words(df, text, "n_repeat_words").drop("t")
    words = F.col("n_words")
    return df.withColumns(
        {
            "short": words < 50,
            "repeated": 100 * F.col("n_repeat_words") > 50 * words,
            "symbols": 10 * F.col("n_symbols") > words,
            "word_length": (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 12 * words),
            "dup_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        }
    )


def host_verdicts(measured: DataFrame, host_rate: float) -> DataFrame:
    """(host, host_docs, <rule>_rate, host_ok) of every host that is not null.

    Beta prior of a rule: mean m and variance v of the hosts' raw rates give
    strength = m (1 - m) / v - 1, at least 1 and at most ``host_docs`` of an average host;
    a = m * strength, b = (1 - m) * strength; shrunk rate = (failures + a) / (documents + a + b).
    """
    sums = [F.sum(F.col(r).cast("long")).alias(r) for r in RULES]
    hosts = measured.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("host_docs"), *sums)
    hosts = materialize(hosts, "hosts")
    rates = {r: F.col(r) / F.col("host_docs") for r in RULES}
    one = hosts.agg(F.avg("host_docs").alias("docs"), *(F.avg(x).alias(f"{r}_m") for r, x in rates.items()), *(F.var_pop(x).alias(f"{r}_v") for r, x in rates.items())).first()
    shrunk = {}
    for r in RULES:
        m, v = one[f"{r}_m"] or 0.0, one[f"{r}_v"] or 0.0
        most = max(one["docs"] or 1.0, 1.0)
        strength = min(max(m * (1 - m) / v - 1, 1.0), most) if v > 0 else most
        shrunk[f"{r}_rate"] = (F.col(r) + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength))
    ok = F.greatest(*shrunk.values()) < F.lit(host_rate)
    return hosts.select("host", "host_docs", *(x.alias(n) for n, x in shrunk.items()), ok.alias("host_ok"))


def judge(docs: DataFrame, *, host_rate: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Documents' counts and verdicts, and hosts' verdicts.

    The first has did, sig, host, the counts, the failed rules as booleans, ``base_failed``
    (fewer than 50 words, or over half of them in repeated windows of three words) and
    ``kept``: no rule failed, and the host not rejected. Documents without a host are judged
    alone. A null or empty text has no words and fails. An empty table gives empty results.
    """
    measured = materialize(counts(docs), "counts")
    hosts = host_verdicts(measured, host_rate)
    base = F.col("short") | F.col("repeated")
    own = F.col("symbols") | F.col("word_length") | F.col("dup_lines")
    judged = measured.join(hosts.select("host", "host_ok"), "host", "left")
    judged = judged.withColumn("base_failed", base).withColumn("kept", ~base & ~own & F.coalesce("host_ok", F.lit(True)))
    return judged, hosts


def keep(docs: DataFrame, *, host_rate: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns."""
    judged, _ = judge(docs, host_rate=host_rate)
    rows, d, s = keyed(docs)
    other = [free_name(rows, x) for x in ("rejected_did", "rejected_sig", "rejected_host")]
    rejected = materialize(judged.where(~F.col("kept")).select("did", "sig", "host").distinct().toDF(*other), "rejected")
    same = (F.col(d) == F.col(other[0])) & (F.col(s) == F.col(other[1])) & F.col("source").eqNullSafe(F.col(other[2]))
    return rows.join(rejected.hint("merge"), same, "left_anti").select(*quoted(docs.columns))  # the same plan at every size
