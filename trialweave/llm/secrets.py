"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Patterns give candidate spans in each whole text. The values they cover are counted over the corpus by
distinct repositories and distinct owners: a value that several owners hold is a copied example, one
that a single owner holds looks like a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import cut_lineage

# fixed values: the three base patterns, in their order
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
# kinds that this scan adds
_END = r"-----END [A-Z ]{0,40}PRIVATE KEY-----"
# what stands between a header and the next END line, or, without one, lines of base64; blanks may be written as \n
_BLANK = r"(?:\s|\\[nr])"
_LINES = r"""(?:%s*+[A-Za-z0-9+/]{16,}+={0,2}+)*+(?:(?:\r?\n|\\n)[ \t]*+[A-Za-z0-9+/]{1,15}={0,2}+(?=[ \t\r]*+(?:\n|$)|["'\\]))?+""" % _BLANK
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----%s*+([^-]*+(?:-(?!----)[^-]*+)*+(?=%s)|%s)(?:%s)?+" % (_BLANK, _END, _LINES, _END)
URL = r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]*+:([^\s/@]++)@"
#: Characters of a key's body at least, and of a value that is replaced wherever it stands.
LEAST_BODY, ANYWHERE = 16, 6
KINDS = ("assign", "access", "hex", "pem", "url")
BASE = KINDS[:3]
#: Owners that make a value a copied example.
COPIED_OWNERS = 3

_SPAN = "array<struct<start:bigint,rank:int,stop:bigint,value:string>>"


def _found(text: Column, test: Column, pattern: str, rank: int, group: int, least: int) -> Column:
    """Spans of a pattern, in code points, with the value they cover; short ones are left out.

    Splitting at the matches gives the texts between them, whose lengths place the matches.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    start = F.lit(0).cast("bigint")
    state = F.struct(start.alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["between"])
        end = begin + F.length(x["whole"])
        span = F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), end.alias("stop"), x["value"].alias("value")
        )
        spans = F.when(F.length(x["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    rows = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(between, 1, F.size(whole)).alias("between"))
    rows = rows.cast("array<struct<whole:string,value:string,between:string>>")
    return F.when(test, F.aggregate(rows, state, step)["spans"]).otherwise(F.array().cast(_SPAN))


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind: (start, rank of the kind, stop, value). NULL counts as empty."""
    t = F.coalesce(text, F.lit(""))
    # a maximal run is at least n long exactly where n of its characters stand together
    run = r"[0-9a-f]{%d,}" % LEAST["hex"]
    access = r"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4)
    parts = [
        _found(t, F.rlike(t, F.lit(ASSIGN)), ASSIGN, 0, 2, LEAST["assign"]),
        _found(t, F.contains(t, F.lit("AKIA")), access, 1, 0, LEAST["access"]),
        _found(t, F.rlike(t, F.lit(run)), run, 2, 0, LEAST["hex"]),
        _found(t, F.contains(t, F.lit("-----BEGIN ")), PEM, 3, 1, LEAST_BODY),
        _found(t, F.contains(t, F.lit("://")), URL, 4, 1, 1),
    ]
    return F.array_sort(F.concat(*parts))


def _text(found: Column, ranks: int) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(found, lambda s: s["rank"] < ranks)
    return F.array_join(
        F.transform(
            kept, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
        ),
        ",",
    )


def _count(found: Column, rank: int) -> Column:
    return F.size(F.filter(found, lambda s: s["rank"] == rank)).cast("long")


def ownership(candidates: DataFrame) -> DataFrame:
    """(key, repositories, owners) over rows (key, repository, owner): distinct counts, combined before each shuffle.

    A missing owner counts as one owner of its own.
    """
    rows = candidates.select("key", "repository", F.coalesce("owner", F.lit("")).alias("owner"))
    owners = rows.select("key", "owner").distinct().groupBy("key").agg(F.count("*").alias("owners"))
    repositories = rows.select("key", "repository").distinct().groupBy("key").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "key")


def _scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"),
        spans(F.col(text_col).cast("string")).alias("found"),
    )


def _values(scanned: DataFrame) -> DataFrame:
    """Distinct (doc_id, owner, value, key) of the scanned rows, with owners counted over the corpus.

    Key bodies that differ in blanks and line ends only are one value.
    """
    rows = scanned.where("size(found) > 0").select("doc_id", "owner", F.explode("found.value").alias("value"))
    rows = cut_lineage(rows.withColumn("key", F.sha2(F.regexp_replace("value", _BLANK, ""), 256)).distinct(), "candidates")
    counted = ownership(rows.select("key", F.col("doc_id").alias("repository"), "owner"))
    return rows.join(counted, "key")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", copied: int = COPIED_OWNERS
) -> DataFrame:
    """One row per row of ``docs``: counts and spans of its secrets, and how many values look live or copied.

    (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied). A missing or empty text has
    no spans. A document is its own repository. Rows that share an id (or have none) share the counts of
    live and copied values. Other columns are ignored.
    """
    scanned = cut_lineage(_scanned(docs, id_col, text_col, owner_col), "scanned")
    named = _values(scanned).groupBy("doc_id").agg(
        F.count_distinct(F.when(F.col("owners") < copied, F.col("key"))).alias("n_live"),
        F.count_distinct(F.when(F.col("owners") >= copied, F.col("key"))).alias("n_copied"),
    )
    named = named.withColumnRenamed("doc_id", "named")
    out = scanned.join(named, scanned.doc_id.eqNullSafe(named.named), "left")
    count = [_count(F.col("found"), r).alias(f"n_{k}") for r, k in enumerate(BASE)]
    return out.select(
        "doc_id",
        *count,
        F.sha2(_text(F.col("found"), len(BASE)), 256).alias("base_sha256"),
        _text(F.col("found"), len(KINDS)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )


def redact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    copied: int = COPIED_OWNERS,
    mark: str = "[SECRET]",
) -> DataFrame:
    """``docs`` with every live-looking value in a text replaced by ``mark``; copied examples and clean texts stay.

    All rows and columns are kept; rows without id keep their text only if they hold no candidate at all.
    """
    scanned = cut_lineage(_scanned(docs, id_col, text_col, owner_col).where("size(found) > 0"), "scanned")
    live = _values(scanned).where(F.col("owners") < copied)
    live = live.groupBy("doc_id").agg(F.collect_set("value").alias("__live")).withColumnRenamed("doc_id", "__named")
    # longer values first, so that none is cut by a value inside it
    order = F.array_sort(F.transform("__live", lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    # a short value, which only URLs have, is replaced in its place between : and @
    anywhere = lambda t, v: F.replace(t, v, F.lit(mark))
    in_url = lambda t, v: F.replace(t, F.concat(F.lit(":"), v, F.lit("@")), F.lit(f":{mark}@"))
    clean = F.aggregate(
        order, F.col(text_col), lambda t, v: F.when(v["n"] > -ANYWHERE, in_url(t, v["v"])).otherwise(anywhere(t, v["v"]))
    )
    joined = docs.join(live, docs[id_col].cast("long").eqNullSafe(live["__named"]), "left")
    return joined.select(
        *[
            F.when(F.col("__live").isNotNull(), clean).otherwise(docs[c]).alias(c) if c == text_col else docs[c]
            for c in docs.columns
        ]
    )
