"""Secrets in whole texts and the multipart credentials they form, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.llm.common import settle, text_of

# The base patterns, in the order of their kinds, and the least length of what counts. Runs of hexadecimal
# digits are whole where no digit stands before, so shorter ones need not be cut out first.
BASE = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The group whose length counts; 0 is the match.
GROUP = {"assign": 2, "access": 0, "hex": 0}

# Weak parts of a credential. A run of 20 or more signs of the base64 alphabet may be a secret; names of
# accounts and keys are identifiers; addresses of services are endpoints.
WEAK = {
    "blob": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}",
    "identifier": r"""(?i:(?:client|access_?key|account|user|key)_?(?:id|name)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9._@-]{4,}""",
    "endpoint": r"(?i:https?|jdbc|postgres|mysql|mongodb|redis|amqp|s3)(?::[a-z]+)?://[A-Za-z0-9._:@/-]+",
}
KINDS = [*BASE, *WEAK]
SECRETS, PARTNERS = ("assign", "hex", "blob"), ("access", "identifier", "endpoint")

#: Parts within so many code points of each other are in one scope.
SCOPE = 200
#: Code points of a bucket of the interval join.
STRIDE = 512
_CHUNK = 256
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add for each pattern an array of `start, kind, end` in code points of its leftmost, non-overlapping matches.

    The pieces between matches and the matches alternate, so ends follow from running lengths, which are summed in
    chunks of matches to stay near linear in long texts.
    """
    kept = df.columns
    df = df.withColumns({f"_f_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    hit = {k: F.size(f"_f_{k}") > 0 for k in patterns}
    df = df.withColumns({f"_b_{k}": F.when(hit[k], F.split(text, p, -1)) for k, p in patterns.items()})
    tails = {k: F.regexp_extract_all(text, F.lit(p), F.lit(GROUP.get(k, 0))) if GROUP.get(k) else F.col(f"_f_{k}") for k, p in patterns.items()}
    df = df.withColumns({f"_t_{k}": F.when(hit[k], tails[k]) for k in patterns})
    out = {}
    for k in patterns:
        n = F.size(f"_f_{k}")
        steps = F.transform(
            F.arrays_zip(F.slice(f"_b_{k}", 1, n).alias("gap"), F.col(f"_f_{k}").alias("match"), F.col(f"_t_{k}").alias("tail")),
            lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("n"), F.length(x["tail"]).alias("tail")),
        )
        df = df.withColumn(f"_s_{k}", F.when(hit[k], steps))
        out[k] = F.when(hit[k], _running(F.col(f"_s_{k}"), KINDS.index(k), LEAST.get(k, 0))).otherwise(F.array().cast(_SPAN))
    return df.withColumns(out).select(*kept, *patterns)


def _running(steps: Column, kind: int, least: int) -> Column:
    def start(at):
        return F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc, m):
        s = acc["at"] + m["gap"]
        e = s + m["n"]
        here = F.array(F.struct(s.alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
        return F.struct(e.alias("at"), F.when(m["tail"] >= least, F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    def chunk(acc, part):
        done = F.aggregate(part, start(acc["at"]), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["spans"], done["spans"]).alias("spans"))

    firsts = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int"))
    parts = F.transform(firsts, lambda i: F.slice(steps, i * _CHUNK + 1, _CHUNK))
    return F.aggregate(parts, start(F.lit(0)), chunk, lambda acc: acc["spans"])


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    texts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))
    return F.array_join(texts, ",")


def _numbers(kinds) -> list[int]:
    return [KINDS.index(k) for k in kinds]


def _in_scopes(parts: DataFrame, reach: int) -> DataFrame:
    low = F.floor(F.greatest(F.col("start") - reach, F.lit(0)) / STRIDE)
    return parts.withColumn("_scope", F.explode(F.sequence(low, F.floor((F.col("end") + reach) / STRIDE))))


def linked_parts(parts: DataFrame) -> DataFrame:
    """Of parts `at, start, kind, end` those that meet a disjoint complementary part within `SCOPE` code points in the same text.

    Secrets are joined with access identifiers and endpoints by text and bucket of positions, so a long text is spread
    over its buckets; both directions are semi joins and give no pairs.
    """
    secrets = _in_scopes(parts.where(F.col("kind").isin(_numbers(SECRETS))), 0)
    partners = _in_scopes(parts.where(F.col("kind").isin(_numbers(PARTNERS))), SCOPE)
    x, y = secrets.alias("x"), partners.alias("y")
    meet = (
        (F.col("x.at") == F.col("y.at")) & (F.col("x._scope") == F.col("y._scope"))
        & (F.col("x.start") <= F.col("y.end") + SCOPE) & (F.col("x.end") + SCOPE >= F.col("y.start"))
        & ((F.col("x.end") <= F.col("y.start")) | (F.col("y.end") <= F.col("x.start")))
    )
    both = x.join(y, meet, "left_semi").unionByName(y.join(x, meet, "left_semi"))
    return both.select("at", "start", "kind", "end").distinct()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, base, linked`: spans (`array<struct<start, kind, end>>`, kind as index into `KINDS`) of every whole text.

    `base` has the matches of the base patterns. `linked` has the weak parts that are reported because a complementary
    part stands in their scope: a blob beside an identifier or endpoint, an identifier or endpoint beside a secret. The two
    are different places: a blob that overlaps a base span, an identifier or an endpoint is a part of that, and no secret. Null texts count as empty and have no spans; null and repeated ids are kept row by row; an
    empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    found = with_spans(texts, "_text", BASE | WEAK).drop("_text")
    base = F.concat(*[F.col(k) for k in BASE])
    others = F.concat("_base", "identifier", "endpoint")
    free = F.filter("blob", lambda b: ~F.exists(others, lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    rows = found.select(F.monotonically_increasing_id().alias("at"), "doc_id", base.alias("_base"), *WEAK)
    rows = settle(rows.select("at", "doc_id", F.col("_base").alias("base"), F.concat(free, "identifier", "endpoint").alias("weak")), "spans")
    parts = rows.where(F.size("weak") > 0).select("at", F.explode(F.concat("base", "weak")).alias("s")).select("at", "s.*")
    weak = linked_parts(parts).where(F.col("kind").isin(_numbers(WEAK)))
    reported = weak.groupBy("at").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    return rows.join(reported, "at", "left").select("doc_id", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked` of every text; spans as `kind:start:end` by start."""
    found = find_secrets(docs, id_col, text_col)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"),
    )
