"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Only DataFrame functions and Spark's own tree learner are used; nothing runs in Python on the executors.
The urls that a rule decides are the labelled ones. The trees learn from a bounded sample of them and
judge the urls that no rule fits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.common import let
from webloom.llm.common import read_table

#: Labelled urls that the trees are fitted on, the lowest by hash: a documented bound on the sample.
SAMPLE = 20_000
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and its subdomains where the url's path starts with ``/path``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path from there up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (of equally long ones the first given), as its text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        at_host = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        out = F.when(at_host & F.startswith(path, F.lit(rule.path)), F.lit(rule.text)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character by the letters, digits and marks of a host name."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    total = F.lit(0.0)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789-._~%":
        n = size - F.length(F.replace(text, F.lit(c), F.lit(""))).cast("double")
        total = total + let(n / size, lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return total


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    return {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "host_parts": F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
        "dash_ratio": F.length(F.regexp_replace(url, "[^-_]", "")) / size,
        "host_entropy": entropy(host),
        "parameters": F.when(F.instr(url, "?") > 0, F.regexp_count(url, F.lit("[?&][^=&#]+="))).otherwise(0),
        "secure": F.startswith(url, F.lit("https")).cast("int"),
    }


def judge(
    pages: DataFrame, rules: list[Rule] | None = None, url: str = "url", sample: int = SAMPLE, trees: int = 12, depth: int = 4,
) -> DataFrame:
    """Adds host, path, rule (text of the rule that decides, else null), score (of "block", null where a rule decides), verdict.

    A null url, or one without ``://``, has an empty host and path and is judged by the trees. Where the rules
    label only one way, that verdict holds for all other urls; where they label none, all are allowed.
    Repeated rows are judged alike, columns of the input with names of new ones are replaced, no rows give none.
    """
    rules = [Rule(*r) for r in RULES] if rules is None else rules
    blocking = [r.text for r in rules if r.verdict == "block"]
    host, path = host_and_path(F.col(url))
    made = ["host", "path", "rule", "score", "verdict"]
    rows = pages.withColumns({"host": host, "path": path}).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    features = lexical(F.col(url), F.col("host"), F.col("path"))
    suffix = F.substring_index("host", ".", -1)
    named = F.col("rule").isin(blocking).cast("double")
    keep = [c for c in pages.columns if c not in made]

    labelled = rows.where("rule IS NOT NULL").select(*[c.cast("double").alias(n) for n, c in features.items()], suffix.alias("suffix"), named.alias("label"), F.xxhash64(url).alias("h"))
    labelled = labelled.orderBy("h", *features, "suffix", "label").limit(sample).coalesce(1).cache()
    sides = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sides) < 2:
        labelled.unpersist()
        verdict = "block" if 1.0 in sides else "allow"
        return rows.select(*keep, "host", "path", "rule", F.when(F.col("rule").isNull(), float(verdict == "block")).alias("score"),
                           F.when(F.col("rule").isNull(), verdict).when(named == 1, "block").otherwise("allow").alias("verdict"))
    share = sides[1.0] / sum(sides.values())
    # smoothed share of blocked urls per last part of the host, from the sample: at most as many rows as it has
    seen = labelled.groupBy("suffix").agg(((F.sum("label") + 20 * share) / (F.count(F.lit(1)) + 20)).alias("suffix_share"), F.count(F.lit(1)).alias("suffix_count"))
    stats = {r["suffix"]: (r["suffix_share"], r["suffix_count"]) for r in seen.collect()}
    by_suffix = pages.sparkSession.createDataFrame([(k, float(v), float(n)) for k, (v, n) in stats.items()], "suffix string, suffix_share double, suffix_count double")

    def with_suffix(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(by_suffix), "suffix", "left").fillna({"suffix_share": share, "suffix_count": 0.0})

    columns = [*features, "suffix_share", "suffix_count"]
    vectors = VectorAssembler(inputCols=columns, outputCol="vector", handleInvalid="keep")
    learner = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False)
    model = learner.fit(vectors.transform(with_suffix(labelled)).select("vector", "label").coalesce(1))
    labelled.unpersist()
    decided = F.when(named == 1, "block").otherwise("allow")
    ruled = rows.where("rule IS NOT NULL").select(*keep, "host", "path", "rule", F.lit(None).cast("double").alias("score"), decided.alias("verdict"))
    # temporary names keep clear of whatever columns the caller has
    own = F.struct(*[F.col(c) for c in keep]).alias("row")
    open_ = rows.where("rule IS NULL").select(own, "host", "path", suffix.alias("suffix"), *[c.cast("double").alias(n) for n, c in features.items()])
    scored = model.transform(vectors.transform(with_suffix(open_)))
    score = vector_to_array("probability")[1]
    scored = scored.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), score.alias("score"), F.when(score >= 0.5, "block").otherwise("allow").alias("verdict"))
    return ruled.unionByName(scored)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score."""
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
