"""Secret scans with ownership frequency over the corpus, in built-in columns.

Candidates are found row by row. Their hashes are counted by distinct
repository and owner over all documents: a string that several owners hold, or one owner in many repositories, is
a copied example or a shared default; one that a single owner holds in a few
repositories and that looks random is a live credential. Long random strings without a known form are kept as
findings only on that evidence.

Only candidates are shuffled, never texts. Counts combine before each shuffle
(copies of a document are one row per owner and repository), and where one
string is in a third of all documents the join that brings the counts back is
split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.llm.spans import match_spans
from stepgrid.session import settle

# fixed values: the patterns of the base scan and of public credential formats
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
FORMATS = {
    "github": (r"gh[opsur]_[A-Za-z0-9]{36,}", ["gh"]),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", ["xox"]),
    "google": (r"AIza[A-Za-z0-9_-]{35}", ["AIza"]),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", ["eyJ"]),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ["PRIVATE KEY"]),
    "url": (r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@", ["://"]),
}
OWNED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, *FORMATS, "owned"]
EXAMPLE_OWNERS = 3  # owners from which a string is a widely copied example
LIVE_REPOSITORIES = 5  # of one owner, in more of them a string is no live credential
CANDIDATE = "array<struct<start:bigint,kind:int,end:bigint,looks:boolean,hash:binary>>"


def _holds(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def _candidates(text: Column, kind: str, spans: Column, secret) -> Column:
    """Structs in the order ``start, kind, end``, which is how findings are sorted."""

    def made(span: Column) -> Column:
        value = secret(span)
        varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
        return F.struct(
            span["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            span["end"].alias("end"),
            (varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]")).alias("looks"),
            F.unhex(F.sha2(value, 256)).alias("hash"),
        )

    return F.transform(spans, made).cast(CANDIDATE)


def candidates(text: Column) -> Column:
    """All candidates of a text, with the hash of the secret itself (the value, for assignments)."""
    none = F.array().cast(CANDIDATE)
    whole = lambda span: F.substring(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
    value = lambda span: F.regexp_extract(whole(span), ASSIGN, 2)
    plain = F.lower(text)
    assigns = F.filter(match_spans(text, ASSIGN), lambda s: F.length(value(s)) >= 6)
    parts = [
        F.when(_holds(plain, ["passw", "secret", "token", "apikey", "api_key"]), _candidates(text, "assign", assigns, value)).otherwise(none),
        F.when(_holds(text, ["AKIA"]), _candidates(text, "access", match_spans(text, ACCESS), whole)).otherwise(none),
        F.when(text.rlike("[0-9a-f]{24}"), _candidates(text, "hex", match_spans(text, HEX), whole)).otherwise(none),
    ]
    for kind, (pattern, words) in FORMATS.items():
        parts.append(F.when(_holds(text, words), _candidates(text, kind, match_spans(text, pattern), whole)).otherwise(none))
    parts.append(F.when(text.rlike("[A-Za-z0-9+/_=-]{20}"), _candidates(text, "owned", match_spans(text, OWNED), whole)).otherwise(none))
    return F.array_sort(F.concat(*parts))


def ownership(found: DataFrame) -> DataFrame:
    """``hash, owners, repositories, documents`` over exploded candidates."""
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("documents"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("documents").alias("documents"))
    return by_owner.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("documents").alias("documents")
    )


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_secrets(docs: DataFrame, repo: Column, owner: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: base counts and digest, all spans, and what ownership says of them.

    Columns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example, live_spans, most_owners, most_repositories``. ``spans`` are
    ``kind:start:end`` by start, then kind; the last two are the largest
    numbers of owners and of repositories that hold one of them (0 without
    spans). A candidate is ``example`` when at least three owners hold its
    secret; ``live`` when one owner does, in at most ``LIVE_REPOSITORIES``
    repositories, and it looks random; a random string
    of no known form is a span only when live and clear of the base spans.
    Null texts count as empty and have no spans; a null owner or repository is
    one more owner or repository; repeated rows get the same result each and
    count once per owner and repository; rows without an id are kept. Only id,
    text and the two given columns are read.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), text.alias("text"))
    rows = rows.withColumn("found", candidates(F.col("text")))
    # rows with equal id and text share their findings
    key = F.when(F.size("found") > 0, F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)), 256))
    rows = settle(rows.select("doc_id", "repo", "owner", "found", key.alias("key")), "candidates")

    each = rows.where("key IS NOT NULL").select("key", "repo", "owner", F.explode("found").alias("c"))
    each = each.select("key", "repo", "owner", "c", F.col("c.hash").alias("hash"))
    held = ownership(each)
    judged = each.select("key", "c", "hash").distinct().join(held.hint("merge"), "hash")
    label = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when((F.col("owners") == 1) & (F.col("repositories") <= LIVE_REPOSITORIES) & F.col("c.looks"), "live").otherwise("unclear")
    judged = judged.select("key", F.struct("c.start", "c.kind", "c.end", label.alias("label"), "owners", "repositories").alias("s"))
    by_doc = judged.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("all"))

    n_base, owned = len(BASE_KINDS), KINDS.index("owned")
    base = F.filter("all", lambda s: s["kind"] < n_base)
    clear = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    by_doc = by_doc.withColumn("base", base)
    by_doc = by_doc.withColumn("spans", F.filter("all", lambda s: (s["kind"] != owned) | ((s["label"] == "live") & clear(s))))
    count = lambda column, test: F.size(F.filter(column, test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    by_doc = by_doc.select(
        "key",
        *[count("base", of_kind(k)).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        _written(F.col("base")).alias("base_spans"),
        _written(F.col("spans")).alias("spans"),
        count("spans", lambda s: s["label"] == "live").alias("n_live"),
        count("spans", lambda s: s["label"] == "example").alias("n_example"),
        _written(F.filter("spans", lambda s: s["label"] == "live")).alias("live_spans"),
        *[F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0)).cast("long").alias(f"most_{c}") for c in ("owners", "repositories")],  # noqa: B023
    )
    # most rows have no finding and no key; they take no part in the join
    columns = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "n_live", "n_example", "live_spans", "most_owners", "most_repositories"]
    none = [(F.lit(0).cast("long") if c.startswith(("n_", "most_")) else F.lit("")).alias(c) for c in columns]
    plain = rows.where("key IS NULL").select("doc_id", *none)
    out = plain.union(rows.where("key IS NOT NULL").select("doc_id", "key").join(by_doc.hint("merge"), "key").select("doc_id", *columns))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_example", "live_spans", "most_owners", "most_repositories")
