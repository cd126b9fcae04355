"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

A scan finds spans of the three base kinds and of wider candidate kinds (private-key headers, prefixed
service tokens, web tokens, long random-looking strings). The secret part of each candidate is hashed and
counted by distinct repositories and owners over the corpus. A value that many owners hold, or that few
owners hold in many repositories, is a copied example; one that at most ``few_owners`` hold in at most
``few_repositories`` and that looks random is live-looking. Base spans are always reported; the method adds the wider
candidates that are live-looking.

Base spans that fail the length rules are dropped. Spans count code points, end exclusive. Matching is leftmost and non-overlapping within a kind.

Defined results: a null text is empty; a null owner or repository counts as one unnamed holder; repeated
rows are scanned and returned once each and add no holder; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, starts, text_of

# The base kinds' patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# The same patterns where only matches long enough are wanted: both kinds match maximal runs.
_ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
_HEX_LONG = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Wider candidates of the method; kinds in the order in which equal starts are listed.
WIDER = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "service": r"(?:ghp_|gho_|xoxb-|xoxp-|sk_live_|AIza)[A-Za-z0-9_-]{20,}",
    "web_token": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "random": r"[A-Za-z0-9+/_-]{32,}",
}
KINDS = ("assign", "access", "hex", *WIDER)
#: Owners, and repositories of all owners, that a live-looking value is in at most.
FEW_OWNERS, FEW_REPOSITORIES = 2, 3


def _found(text: Column, pattern: str, kind: int, secret_group: int = 0) -> Column:
    """array<struct<start, end, kind, secret>> of all matches: starts follow from the pieces between them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(secret_group)) if secret_group else whole
    piece = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), secret.alias("secret"))
    none = F.expr("cast(array() as array<struct<start: int, end: int, kind: int, secret: string>>)")

    def placed(p: Column) -> Column:
        gap, own = (lambda x: F.length(x["gap"])), (lambda x: F.coalesce(F.length(x["whole"]), F.lit(0)))  # the last piece has a gap only
        span = lambda x, at: F.struct((at + gap(x)).alias("start"), (at + gap(x) + own(x)).alias("end"), F.lit(kind).alias("kind"), x["secret"].alias("secret"))
        return F.filter(F.zip_with(p, starts(F.transform(p, lambda x: gap(x) + own(x))), span), lambda s: s["secret"].isNotNull())

    return F.when(text.rlike(pattern), let(piece, placed)).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _looks_random(secret: Column) -> Column:
    classes = sum(F.when(secret.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    distinct = F.size(F.array_distinct(F.split(secret, "")))
    return ((classes >= 2) & (distinct >= 10)) | secret.startswith("-----BEGIN")


def scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without its text, with base and wider: arrays of struct<start, end, kind, secret>."""
    text = text_of(text_column)
    base = F.concat(
        F.filter(_found(text, ASSIGN, 0, 2), lambda s: F.length(s["secret"]) >= ASSIGN_LEAST),
        _found(text, _ACCESS_LONG, 1),
        _found(text, _HEX_LONG, 2),
    )
    # every wider kind has a run of 20 such characters or dashes
    wider = F.when(text.rlike(r"[A-Za-z0-9+/_.-]{20}|-----BEGIN"), F.concat(*(_found(text, p, len(KINDS) - len(WIDER) + i) for i, p in enumerate(WIDER.values()))))
    return docs.select(*(c for c in docs.columns if c != text_column), base.alias("base"), F.coalesce(wider, F.slice(F.col("base"), 1, 0)).alias("wider"))


def ownership(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """(secret, n_repositories, n_owners, n_spans) of every candidate value, by its SHA-256."""
    each = found.select(repository.alias("r"), owner.alias("o"), F.explode(F.concat("base", "wider")).alias("s"))
    held = each.groupBy(F.sha2("s.secret", 256).alias("secret"), F.coalesce("o", F.lit("\0")).alias("o"), F.coalesce("r", F.lit("\0")).alias("r")).agg(F.count("*").alias("n"))
    owned = held.groupBy("secret", "o").agg(F.sum("n").alias("n"), F.count("*").alias("n_r"))
    return owned.groupBy("secret").agg(F.sum("n_r").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("n").alias("n_spans"))


def secret_spans(docs: DataFrame, repository: Column, owner: Column, few_owners: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """Each row of ``docs`` (doc_id, text and what the two expressions need) with its spans and counts of live and copied values."""
    found = cut(
        scan(docs.select("doc_id", text_of().alias("text"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))).withColumn("row", F.monotonically_increasing_id()),
        "found")
    counts = ownership(found, F.col("repository"), F.col("owner"))
    each = found.where("size(base) + size(wider) > 0").select("row", F.explode(F.concat("base", "wider")).alias("s")).withColumn("secret", F.sha2("s.secret", 256))
    copied = (F.col("n_owners") > few_owners) | (F.col("n_repositories") > few_repositories)
    judged = each.join(counts, "secret").withColumn("copied", copied).withColumn("live", ~F.col("copied") & _looks_random(F.col("s.secret")))
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("live") & (F.col("s.kind") >= 3), F.struct("s.start", "s.end", "s.kind", "s.secret"))).alias("added"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
    )
    return found.join(by_row, "row", "left").select(
        "doc_id", "repository", "owner", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")).alias("all_spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In ``documents`` the owner is the source, and a source's texts of one language are a repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = secret_spans(docs, F.concat_ws("/", F.coalesce("source", F.lit("\0")), F.coalesce("lang", F.lit("\0"))), F.col("source"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"), "n_live", "n_copied",
    )
