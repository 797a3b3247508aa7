"""URL filters: host and path rules, then a ratio of two character language models, with DataFrame functions only.

Rules name a host, with all its subdomains, and a prefix of the path; of the rules that fit, the longest decides. The
URLs that rules decide are the training text of two variable-order Markov models, one of allowed and one of blocked
URLs. A character is predicted from the longest context of up to ``ORDER - 1`` characters, and shorter ones lend their
estimate with Witten-Bell weights down to the uniform one, so every URL has a finite score. The score is the difference
of the two log-likelihoods per character. Its threshold is calibrated on the URLs that rules decide: the point between
the means of both classes that lies equally many standard deviations from either.

The models are trained on, and score, whole URLs: scheme, host, path, query and fragment as they stand.

Counts are made per distinct gram before they are joined, and every position of a URL needs one looked-up row: the
score of the gram that ends there. Grams that stand at a thousandth of all positions or more, as those of ``https://``,
are a thousand at most and are broadcast; all others are joined by their gram. A URL without ``://`` has an empty host
and path and fits no rule, but is scored like others; a null one is scored as the empty string. With no allowed or no blocked training URL, there is nothing to compare and the verdict is
``allow``. Repeated rows get the same verdict. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

ORDER = 5
#: Stands before the first character, and after the last one, of what the models read.
BEGIN, END = "\x02", "\x03"
UNIFORM = 1.0 / 256
#: A gram is common if it stands at this part of all positions, so there are so many common ones at most.
COMMON = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed rules.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(after, "(?s)^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first), and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, text (the URL, null as empty), host, path, rule, verdict (by rules alone)."""
    host, path = host_and_path(pages["url"])
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("text"), host.alias("host"), path.alias("path"))
    return own.select("page_id", "text", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def grams(text: Column) -> Column:
    """The gram of up to ORDER characters that ends at each position of text + END, begun with BEGIN marks."""
    long = F.concat(F.lit(BEGIN * (ORDER - 1)), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(long, i, F.lit(ORDER)))


def model(counts: DataFrame) -> DataFrame:
    """gram, n_allow, n_block (of all positions of any URL) -> gram and its log ratio.

    From order 1 up, the estimate of a gram's last character after its context mixes the share it has there with the
    estimate of the next shorter gram: p = (n + t * shorter) / (total + t), t being the distinct characters seen.
    """
    estimate = None
    for k in range(1, ORDER + 1):
        own = counts.select(F.substring("gram", -k, k).alias("gram"), "n_allow", "n_block").groupBy("gram").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))
        own = own.withColumn("context", F.substring("gram", 1, k - 1))
        seen = own.groupBy("context").agg(
            *[f.alias(a) for c in ("allow", "block") for f, a in ((F.sum(f"n_{c}"), f"all_{c}"), (F.count(F.when(F.col(f"n_{c}") > 0, 1)), f"kinds_{c}"))]
        )
        own = own.join(seen, "context")
        if estimate is None:
            own = own.withColumns({"s_allow": F.lit(UNIFORM), "s_block": F.lit(UNIFORM)})
        else:
            shorter = estimate.select(F.col("gram").alias("short"), F.col("p_allow").alias("s_allow"), F.col("p_block").alias("s_block"))
            own = own.withColumn("short", F.substring("gram", -(k - 1), k - 1)).join(shorter, "short")
        for c in ("allow", "block"):
            some = F.col(f"all_{c}") > 0
            mixed = (F.col(f"n_{c}") + F.col(f"kinds_{c}") * F.col(f"s_{c}")) / F.when(some, F.col(f"all_{c}") + F.col(f"kinds_{c}")).otherwise(F.lit(1))
            own = own.withColumn(f"p_{c}", F.when(some, mixed).otherwise(F.col(f"s_{c}")))
        estimate = written(own.select("gram", "p_allow", "p_block"), f"order{k}")
    return estimate.select("gram", (F.ln("p_allow") - F.ln("p_block")).alias("ratio"))


def classify(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    rows = written(judged(pages, rules), "judged")
    # a URL that repeats is scored once
    urls = rows.groupBy("text").agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("allow"), F.count(F.when(F.col("verdict") == "block", 1)).alias("block"), F.count(F.when(F.col("verdict").isNull(), 1)).alias("open"),
    )
    urls = written(urls.withColumn("uid", F.monotonically_increasing_id()), "urls")
    at = urls.select("uid", "allow", "block", F.explode(grams(F.col("text"))).alias("gram"))
    counts = written(at.groupBy("gram").agg(F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block"), F.count(F.lit(1)).alias("n_all")), "grams")
    ratios = model(counts)
    common = counts.crossJoin(F.broadcast(counts.agg(F.sum("n_all").alias("positions")))).filter(COMMON * F.col("n_all") >= F.col("positions")).select("gram")
    common = written(ratios.join(common, "gram"), "common")
    looked = at.select("uid", "gram").join(F.broadcast(common), "gram", "left")
    rest = looked.filter("ratio is null").drop("ratio").join(ratios, "gram")
    scored = looked.filter("ratio is not null").unionByName(rest).groupBy("uid").agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("n"))
    scored = scored.select("uid", (F.col("total") / F.col("n")).alias("score"))
    scores = written(urls.join(scored, "uid").select("text", "allow", "block", "score"), "scores")

    def mean(c: str) -> Column:
        return F.sum(F.col("score") * F.col(c)) / F.when(F.sum(c) > 0, F.sum(c))

    def square(c: str) -> Column:
        return F.sum(F.col("score") * F.col("score") * F.col(c)) / F.when(F.sum(c) > 0, F.sum(c))

    line = scores.agg(mean("allow").alias("m_a"), square("allow").alias("q_a"), mean("block").alias("m_b"), square("block").alias("q_b"))
    line = line.select("m_a", "m_b", F.sqrt(F.greatest(F.col("q_a") - F.col("m_a") ** 2, F.lit(1e-12))).alias("d_a"), F.sqrt(F.greatest(F.col("q_b") - F.col("m_b") ** 2, F.lit(1e-12))).alias("d_b"))
    # one row
    line = line.select(((F.col("m_a") * F.col("d_b") + F.col("m_b") * F.col("d_a")) / (F.col("d_a") + F.col("d_b"))).alias("threshold"))
    by_text = scores.crossJoin(F.broadcast(line)).select("text", "score", F.when(F.col("score") < F.col("threshold"), "block").otherwise("allow").alias("by_model"))
    ruled = rows.filter("verdict is not null").drop("text").withColumn("score", F.lit(None).cast("double"))
    open_rows = rows.filter("verdict is null").drop("verdict").join(by_text, "text")
    return ruled.unionByName(open_rows.select("page_id", "host", "path", "rule", F.col("by_model").alias("verdict"), "score"))
