"""Secret scans with corpus-wide ownership frequency (native expressions only).

Candidates are found by three patterns in every whole text. The hash of each candidate's value is then counted over the
corpus: in how many repositories and under how many owners it stands. A value that many owners or many repositories carry is
an example that was copied around; a value that few of both hold looks live, unless it is a placeholder, or a bare run of hex
digits without the mixed characters of a generated key. Each live candidate adds a span of kind `live` over its value; the
candidates' own spans always stay.

Positions come from splitting the text at the matches: the lengths of the gaps and of the matches add up to the starts.
The patterns run only on texts that hold one of their fixed parts.

Hot values: distinct (value, repository) and (value, owner) pairs are formed before anything is counted per value, so
counting combines map-side, and the counts are joined back under a salt of the row.

Defined cases: a null text is empty; a null owner or repository counts as one owner or repository of its own (the text
''); repeated rows each get their spans, and count once per repository; a value at the limit of either count is copied; texts
of any length are searched whole, with work in proportion to the matches; an empty table gives no rows; extra columns, whatever
their names, are ignored or, where rows are returned with their own columns, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlens.llm.common import free_name, stored, with_row_id

#: The patterns, their order and the least lengths.
ASSIGN = (
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "live")
#: A value under at least so many owners is a copied example; under at most so many it may be live.
COPIED_OWNERS, LIVE_OWNERS = 3, 2
#: A value in at least so many repositories is a copied example, whoever owns them.
COPIED_REPOSITORIES = 20
LIVE_LEAST = 16
PLACEHOLDER = r"(?i)example|placeholder|change_?-?me|your[_-]|dummy|redacted|^(?:none|null|undefined|true|false|string|password|passwd|secret|token|api_?key)$"
SALTS = 16
FULL = 256


def _appending(items: Column, state: Column, kind: str, step) -> Column:
    """array<kind>: what step(state, item) -> (next state, value or null) gives for the items, in time in proportion to them.

    Values are gathered by the FULL, so that no long array is copied for each of them.
    """
    start = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("last"), F.array().cast(f"array<array<{kind}>>").alias("full"))

    def one(acc: Column, item: Column) -> Column:
        after, value = step(acc["state"], item)
        closed = F.size(acc["last"]) >= FULL
        last = F.when(closed, F.array(value)).otherwise(F.concat(acc["last"], F.array(value)))
        full = F.when(closed, F.concat(acc["full"], F.array(acc["last"]))).otherwise(acc["full"])
        return F.struct(after.alias("state"), last.alias("last"), full.alias("full"))

    return F.filter(F.aggregate(items, start, one, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["last"])))), lambda x: x.isNotNull())


def _found(text: Column, pattern: str) -> Column:
    """array<struct(start bigint, hit string)> of all leftmost matches that don't overlap."""
    pairs = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit"))
    )

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        begin = at + pair["gap"]
        return begin + F.coalesce(F.char_length(pair["hit"]), F.lit(0)), F.when(pair["hit"].isNotNull(), F.struct(begin.alias("start"), pair["hit"].alias("hit")))

    return _appending(pairs, F.lit(0).cast("bigint"), "struct<start:bigint,hit:string>", step)


def candidates(text: Column) -> Column:
    """array<struct(start, kind, end, value_start, value)>; kind is the place in KINDS."""
    none = F.array().cast("array<struct<start:bigint,hit:string>>")
    lowered = F.lower(text)
    named = F.contains(lowered, F.lit("passw")) | F.contains(lowered, F.lit("secret")) | F.contains(lowered, F.lit("token")) | F.contains(lowered, F.lit("api"))

    def spans(kind: int, hits: Column, prefix) -> Column:
        def span(x: Column) -> Column:
            skip = prefix(x["hit"])
            return F.struct(
                x["start"].alias("start"),
                F.lit(kind).alias("kind"),
                (x["start"] + F.char_length(x["hit"])).alias("end"),
                (x["start"] + skip).alias("value_start"),
                F.substring(x["hit"], skip + 1, F.char_length(x["hit"])).alias("value"),
            )

        return F.transform(hits, span)

    def key_length(hit: Column) -> Column:
        return F.char_length(F.regexp_extract(hit, f"^{ASSIGN}$", 1))

    assigned = F.filter(spans(0, F.when(named, _found(text, ASSIGN)).otherwise(none), key_length), lambda s: F.char_length(s["value"]) >= ASSIGN_LEAST)
    access = spans(1, F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS)).otherwise(none), lambda hit: F.lit(0))
    hexed = spans(2, F.when(text.rlike(HEX), _found(text, HEX)).otherwise(none), lambda hit: F.lit(0))
    return F.array_sort(F.concat(assigned, access, hexed))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the given order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def looks_generated(value: Column) -> Column:
    """At least LIVE_LEAST characters, with a digit, a letter and eight different characters."""
    return (F.char_length(value) >= LIVE_LEAST) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def looks_like_placeholder(value: Column) -> Column:
    """Fewer than three different characters, or a word that stands for a value."""
    return (F.size(F.array_distinct(F.split(value, ""))) < 3) | value.rlike(PLACEHOLDER)


def frequency_rule(value: Column, kind: Column, owners: Column, repositories: Column) -> Column:
    """Whether a value is live by the numbers of its owners and repositories.

    An assigned value or access key counts from the contract's least length on unless it is a placeholder; a bare run of hex
    digits, which nothing names as a secret, must look generated.
    """
    looks = F.when(kind == 2, looks_generated(value)).otherwise(~looks_like_placeholder(value))
    return (owners <= LIVE_OWNERS) & (repositories < COPIED_REPOSITORIES) & looks


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, repositories, owners) of every candidate value; found has value_hash, repository, owner."""
    repositories = found.select("value_hash", "repository").distinct().groupBy("value_hash").agg(F.count("*").alias("repositories"))
    owners = found.select("value_hash", "owner").distinct().groupBy("value_hash").agg(F.count("*").alias("owners"))
    return repositories.join(owners, "value_hash")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", rule=frequency_rule) -> DataFrame:
    """A row per document: base and added spans, and the greatest numbers of owners and of repositories over its values.

    Columns: _rid, id, base (array of candidate spans), live (array of added spans), n_copied, n_live, owners, repositories.
    """
    blank = F.lit("")
    scanned = with_row_id(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(owner_col).cast("string"), blank).alias("owner"),
            F.coalesce(F.col(repository_col).cast("string"), blank).alias("repository"),
            candidates(F.coalesce(F.col(text_col), blank)).alias("base"),
        )
    )
    rows = stored(scanned, "secrets")
    found = rows.filter(F.size("base") > 0).select("_rid", "owner", "repository", F.explode("base").alias("span"))
    found = found.withColumn("value_hash", F.sha2(F.col("span.value").cast("binary"), 256))
    counts = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = found.withColumn("salt", F.pmod(F.xxhash64("_rid"), F.lit(SALTS)).cast("int")).join(counts, ["value_hash", "salt"])
    live = rule(F.col("span.value"), F.col("span.kind"), F.col("owners"), F.col("repositories"))
    per_doc = (
        judged.groupBy("_rid")
        .agg(
            F.array_sort(F.collect_set(F.when(live, F.struct(F.col("span.value_start").alias("start"), F.lit(3).alias("kind"), F.col("span.end").alias("end"))))).alias("live"),
            F.count_if((F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES)).alias("n_copied"),
            F.max("owners").alias("owners"),
            F.max("repositories").alias("repositories"),
        )
    )
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return (
        rows.join(per_doc, "_rid", "left")
        .withColumn("live", F.coalesce("live", empty))
        .select("_rid", "id", "base", "live", F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"), F.size("live").cast("bigint").alias("n_live"), F.coalesce("owners", F.lit(0)).alias("owners"), F.coalesce("repositories", F.lit(0)).alias("repositories"))
    )


def secret_digest(docs: DataFrame, **columns: str) -> DataFrame:
    """The columns of the query's contract, derived from secret_spans."""
    rows = secret_spans(docs, **columns)
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return rows.select(
        F.col("id").alias("doc_id"),
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(spans_text(plain).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat(plain, F.col("live")))).alias("spans"),
        "n_copied",
        "n_live",
        "owners",
        "repositories",
    )


def masked(text: Column, spans: Column) -> Column:
    """text with the characters of the spans, in order of their starts, replaced by as many `*`."""

    def step(at: Column, span: Column) -> tuple[Column, Column]:
        begin, end = F.greatest(span["start"], at), F.greatest(span["end"], at)
        kept = F.substring(text, (at + 1).cast("int"), (begin - at).cast("int"))
        return end, F.struct(F.concat(kept, F.repeat(F.lit("*"), (end - begin).cast("int"))).alias("part"), end.alias("end"))

    def rest(parts: Column) -> Column:
        end = F.coalesce(F.array_max(F.transform(parts, lambda x: x["end"])), F.lit(0).cast("bigint"))
        return F.concat(F.array_join(F.transform(parts, lambda x: x["part"]), ""), F.substring(text, (end + 1).cast("int"), F.char_length(text)))

    parts = _appending(spans, F.lit(0).cast("bigint"), "struct<part:string,end:bigint>", step)
    return F.get(F.transform(F.array(parts), rest), F.lit(0))


def without_live_secrets(docs: DataFrame, text_col: str = "text", **columns: str) -> DataFrame:
    """docs with every live value's characters replaced by `*`; copied examples and all else stay, and so do all columns.

    Only rows with candidates are set aside and judged; the others pass as they are.
    """
    base, row, live = free_name(docs, "_base"), free_name(docs, "_row"), free_name(docs, "_live")
    scanned = docs.withColumn(base, candidates(F.coalesce(F.col(text_col), F.lit(""))))
    hits = stored(with_row_id(scanned.filter(F.size(base) > 0), row).withColumn(row, F.col(row).cast("string")), "masked")
    judged = secret_spans(hits, id_col=row, text_col=text_col, **columns).filter(F.size("live") > 0).select(F.col("id").alias(row), F.col("live").alias(live))
    covered = hits.join(judged, row, "left").withColumn(text_col, F.when(F.col(live).isNotNull(), masked(F.col(text_col), F.col(live))).otherwise(F.col(text_col)))
    return scanned.filter(F.size(base) == 0).select(*docs.columns).unionByName(covered.select(*docs.columns))
