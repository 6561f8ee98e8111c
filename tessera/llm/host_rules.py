"""Quality rules judged by host.

Every text is measured and held against a few rules. A host's failures of each rule are counted and
its rate is shrunk towards the rate of all hosts by a beta prior, fitted to the hosts by moments: a
host with few documents is near that rate, one with many near its own. The rates decide about
documents: a host that most likely fails a rule more often than not is rejected with all it has; a
rule that a host breaks habitually counts against those of its documents that break it; a rule that
a host breaks hardly ever does not.

Everything is DataFrame work. Repeated windows of words are found inside a row: hashes propose them, strings confirm them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import others, quoted, table
from tessera.session import written

WINDOW_WORDS, FEWEST_WORDS, MOST_REPEATED = 5, 10, 20
#: Shrunk rates from which a host is rejected, and from which breaking a rule is its habit.
REJECTED, HABIT = 0.5, 0.05
#: Bounds of the correlation of a host's documents, from which the prior's strength follows; the least is taken where hosts do not differ.
LEAST_RHO, MOST_RHO = 1e-6, 1 - 1e-6
SPACE = "[\\x09-\\x0D ]+"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: What counts as a failure, in words of METRICS. The first two are the base rules, which need no host.
RULES = {
    "short": f"n_words < {FEWEST_WORDS}",
    "repeats": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "long_words": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
}
BASE = ("short", "repeats")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _met_again(keyed: Column) -> Column:
    """The places of (key, place) whose key others have too, in the order of keys."""

    def twin(sorted_: Column) -> Column:
        kept = F.filter(sorted_, lambda s, k: (s["key"] == F.get(sorted_, k - 1)["key"]) | (s["key"] == F.get(sorted_, k + 1)["key"]))
        return F.transform(kept, lambda s: s["place"])

    return let(F.sort_array(keyed), twin)


def repeated_words(words: Column, size: int = WINDOW_WORDS) -> Column:
    """How many of the words are in a window of ``size`` words that is found twice or more."""

    def window(at: Column) -> Column:
        return F.slice(words, at + 1, size)

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(starts, k + 1) - p, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def found(hashes: Column) -> Column:
        alike = _met_again(F.transform(hashes, lambda h, k: F.struct(h.alias("key"), k.alias("place"))))
        same = _met_again(F.transform(alike, lambda p: F.struct(F.array_join(window(p), " ").alias("key"), p.alias("place"))))
        # most texts repeat no window, which the number of different hashes tells at once
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(same), covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda k: F.xxhash64(window(k)))
    return F.when(F.size(words) <= size, F.lit(0)).otherwise(let(hashes, found))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with METRICS of its texts, as longs; input columns of these names are replaced.

    Words are maximal runs without ASCII white space, word_chars their code points, n_symbols characters of
    ``#*$%&|<>``, n_lines the lines with a word, n_dup_lines those equal to an earlier line, and n_repeat_words
    words in windows of five that the text has twice or more. Null and empty texts have none of these.
    """
    value = F.coalesce(quoted(text), F.lit(""))
    kept = others(df, *METRICS)
    cut = df.select(
        F.struct(*(quoted(c) for c in kept)).alias("row"),
        F.array_remove(F.split(value, SPACE), "").alias("words"),
        F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"),
        (F.size(F.split(value, "[#*$%&|<>]")) - 1).alias("symbols"),
    )
    made = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.col("symbols"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words")),
        "n_lines": F.size("lines"),
    }
    return cut.select(*(F.col("row")[c].alias(c) for c in kept), *(c.cast("long").alias(n) for n, c in made.items()))


def host_rates(measured: DataFrame, host: str = "source") -> tuple[DataFrame, dict[str, float]]:
    """(host, n, and for each rule its shrunk rate) of measured documents, and the rates of all hosts together.

    The prior of a rule has the pooled rate as its mean; its strength comes from how much more the hosts' rates
    differ than documents drawn at random would make them. Hosts that do not differ get the pooled rate.
    Documents with a null host are in no host. One row of sums comes to the driver.
    """
    failed = {r: F.coalesce(F.expr(rule), F.lit(False)) for r, rule in RULES.items()}
    known = measured.where(quoted(host).isNotNull())
    # a host's rows are summed up in every task before they meet
    counts = known.groupBy(quoted(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(f).alias(r) for r, f in failed.items()))
    sums = counts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("squares"), *(x for r in RULES for x in (F.sum(r).alias(r), F.sum(F.col(r).cast("double") ** 2 / F.col("n")).alias(f"{r}_squares")))).first()
    means, rates = {}, []
    for r in RULES:
        n = sums["n"] or 0
        mean = means[r] = sums[r] / n if n else 0.0
        spread, room = mean * (1 - mean), n - sums["squares"] / n - (sums["hosts"] - 1) if n else 0.0
        rho = ((sums[f"{r}_squares"] - n * mean * mean) / spread - (sums["hosts"] - 1)) / room if spread > 0 and room > 0 else 0.0
        strength = 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1
        rates.append(((F.col(r) + mean * strength) / (F.col("n") + strength)).alias(r))
    return counts.select("host", "n", *rates), means


def judge(measured: DataFrame, host: str = "source") -> DataFrame:
    """``measured`` with base_failed, host_rejected and kept; columns of these names are replaced.

    A document is kept unless it fails a base rule, its host is rejected, or it breaks a rule that its host
    breaks habitually. One with a null host is judged by the rates of all hosts. The rows are read twice, so
    ``measured`` is best a written table. Hosts' verdicts are joined as any table is; where Spark finds them
    small it sends them to the rows, and otherwise splits a host that holds most of these.
    """
    rates, means = host_rates(measured, host)
    soft = [r for r in RULES if r not in BASE]
    rejected = F.greatest(*(F.col(r) for r in RULES)) > REJECTED
    verdicts = rates.select("host", F.struct(rejected.alias("rejected"), *((F.col(r) >= HABIT).alias(r) for r in soft)).alias("verdict"))
    unknown = F.struct(F.lit(max(means.values()) > REJECTED).alias("rejected"), *(F.lit(means[r] >= HABIT).alias(r) for r in soft))
    kept = others(measured, "base_failed", "host_rejected", "kept")
    rows = measured.select(quoted(host).alias("host"), F.struct(*(quoted(c) for c in kept)).alias("row"), *(F.coalesce(F.expr(RULES[r]), F.lit(False)).alias(r) for r in RULES))
    joined = rows.join(verdicts, "host", "left").withColumn("verdict", F.coalesce("verdict", unknown))
    base, against = F.lit(False), F.col("verdict")["rejected"]
    for r in RULES:
        base, against = (base | F.col(r), against) if r in BASE else (base, against | F.col(r) & F.col("verdict")[r])
    return joined.select(*(F.col("row")[c].alias(c) for c in kept), base.alias("base_failed"), F.col("verdict")["rejected"].alias("host_rejected"), (~base & ~against).alias("kept"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, its base rules, and whether it is kept at its host (its source)."""
    measured = written(measure(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    return judge(measured).select("doc_id", *METRICS[:5], "base_failed", "kept", "n_lines", "host_rejected")


def _shrunk(rule: str) -> str:
    mean = f"sum({rule}) OVER () / sum(n) OVER ()"
    spread, hosts = f"({mean}) * (1 - {mean})", "(count(*) OVER () - 1)"
    room = f"(sum(n) OVER () - (sum(n * n) OVER ())::DOUBLE / sum(n) OVER () - {hosts})"
    rho = f"CASE WHEN {spread} > 0 AND {room} > 0 THEN ((sum({rule}::DOUBLE * {rule} / n) OVER () - sum(n) OVER () * ({mean}) * ({mean})) / ({spread}) - {hosts}) / {room} ELSE 0 END"
    return f"{mean} AS {rule}_mean, 1 / least(greatest({rho}, {LEAST_RHO}), {MOST_RHO}) - 1 AS {rule}_strength"


OP11_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, row_number() OVER () AS k FROM documents
), spots AS (
  SELECT k, spot, array_to_string(words[spot : spot + {WINDOW_WORDS - 1}], ' ') AS phrase FROM (SELECT k, words, unnest(range(1, len(words) - {WINDOW_WORDS - 2})) AS spot FROM docs)
), covered AS (
  SELECT k, count(DISTINCT word) AS n FROM (SELECT k, unnest(range(spot, spot + {WINDOW_WORDS})) AS word FROM (SELECT *, count(*) OVER (PARTITION BY k, phrase) AS times FROM spots) WHERE times > 1) GROUP BY k
), measured AS (
  SELECT doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines FROM docs LEFT JOIN covered USING (k)
), ruled AS (
  SELECT *, {", ".join(f"({rule}) AS {name}" for name, rule in RULES.items())} FROM measured
), counts AS (
  SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {r}) AS {r}" for r in RULES)} FROM ruled WHERE source IS NOT NULL GROUP BY source
), priors AS (
  SELECT *, {", ".join(_shrunk(r) for r in RULES)} FROM counts
), rates AS (
  SELECT source, {", ".join(f"({r} + {r}_mean * {r}_strength) / (n + {r}_strength) AS {r}_rate" for r in RULES)} FROM priors
), means AS (
  SELECT {", ".join(f"max({r}_mean) AS {r}_mean" for r in RULES)} FROM priors
), held AS (
  SELECT r.*, {", ".join(f"coalesce({r}_rate, {r}_mean, 0) AS {r}_held" for r in RULES)} FROM ruled r LEFT JOIN rates USING (source) CROSS JOIN means
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats OR greatest({", ".join(f"{r}_held" for r in RULES)}) > {REJECTED} OR {" OR ".join(f"{r} AND {r}_held >= {HABIT}" for r in RULES if r not in BASE)}) AS kept,
       n_lines, greatest({", ".join(f"{r}_held" for r in RULES)}) > {REJECTED} AS host_rejected
FROM held
"""
