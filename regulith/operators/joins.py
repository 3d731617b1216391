"""Joins: scores, sources, keyword dictionaries, registry comparison, duplicates, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.functions.scoring import any_of
from regulith.functions.text import simple_tokens
from regulith.session import col, materialise
from regulith.sources import vocab


def lookup(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Batch form of a point lookup: rows whose key is in the key table."""
    return df.join(keys, on, "left_semi")


def merge_scores(vec: DataFrame, txt: DataFrame, on=("question_id", "citation_id")) -> DataFrame:
    return vec.join(txt, list(on), "left").withColumn("tscore", F.coalesce("tscore", F.lit(0.0)))


def with_source(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations with the label of their source; Catalyst broadcasts the sources only when they are small."""
    return citations.join(sources, "domain")


def domain_semi_join(df: DataFrame, allow: DataFrame, anti: bool = False) -> DataFrame:
    from regulith.operators.filters import allow_domains

    return allow_domains(df, allow, anti=anti)


def match_keywords(df: DataFrame, rules: dict[str, list[str]], text_col: str, id_col: str) -> DataFrame:
    """One row per (id, topic) whose keyword list hits the text: one scan, the dictionary is part of the plan."""
    text = F.lower(F.col(text_col))
    topics = F.array(*[F.when(any_of(text, words), F.lit(name)) for name, words in rules.items()])
    hits = F.filter(topics, lambda t: t.isNotNull())
    return df.select(id_col, F.explode(hits).alias("topic"))


def sync_diff(desired: DataFrame, current: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Compare two versions of a table: action per key is insert, update, noop or orphan."""
    left = desired.select(key, F.struct(*cols).alias("new"))
    right = current.select(key, F.struct(*cols).alias("old"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))
    action = (
        F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "orphan")
        .when(same, "noop").otherwise("update")
    )
    return left.join(right, key, "full_outer").withColumn("action", action)


def with_superseding(citations: DataFrame) -> DataFrame:
    """Each citation with title and date of the one that replaced it.

    Many rows may point at one replacement, so the side with distinct ids is the looked-up one and
    AQE splits the skewed side; rows without a replacement do not travel at all.
    """
    newer = citations.select(
        F.col("citation_id").alias("superseded_by"), F.col("title").alias("new_title"), F.col("effective_date").alias("new_date")
    )
    replaced = citations.filter(F.col("superseded_by").isNotNull()).join(newer, "superseded_by", "left")
    kept = citations.filter(F.col("superseded_by").isNull())
    return replaced.unionByName(kept, allowMissingColumns=True)


def first_seen(df: DataFrame, key: str, id_col: str, ts: str) -> DataFrame:
    """First id per key: a partial aggregate shrinks hot keys before the shuffle."""
    first = F.min(F.struct(F.col(ts), F.col(id_col))).alias("_first")
    return df.groupBy(key).agg(first).select(key, F.col(f"_first.{id_col}").alias("first_id"))


def mark_duplicates(snapshots: DataFrame, key: str = "checksum", id_col: str = "page_id", ts: str = "fetched_at") -> DataFrame:
    """Adds ``duplicate_of``: the first row with the same checksum, NULL for that row itself.

    A window would bring a hot checksum into one task; the aggregate and the skew-split join do not.
    """
    firsts = first_seen(snapshots, key, id_col, ts)
    joined = snapshots.join(firsts, key, "left")
    return joined.withColumn(
        "duplicate_of", F.when(F.col("first_id") != F.col(id_col), F.col("first_id"))
    ).drop("first_id")


def priority_sources(sources: DataFrame, asset_map: DataFrame) -> DataFrame:
    """Enabled sources serving an asset: domain is listed for it and the document classes overlap."""
    enabled = sources.filter("enabled")
    joined = enabled.join(asset_map, "domain").filter(F.arrays_overlap("doc_classes", "wanted_classes"))
    return joined.withColumn("priority_rank", rank_of("priority", vocab.PRIORITY_ORDER, 3))


def rank_of(c: Column | str, order: dict[str, int], default: int) -> Column:
    out = F
    for name, rank in order.items():
        out = out.when(col(c) == name, F.lit(rank))
    return out.otherwise(F.lit(default))


def map_value(c: Column | str, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Literal map lookup; NULL (or the default) for an unknown key."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(pairs, col(c))
    return found if default is None else F.coalesce(found, default)


def normalize_alias(df: DataFrame, name: str, aliases: dict[str, str]) -> DataFrame:
    """Canonical spelling of a key column; unknown spellings become NULL and are flagged."""
    out = df.withColumn(f"{name}_norm", map_value(F.lower(F.trim(F.col(name))), aliases))
    return out.withColumn(f"{name}_valid", F.col(f"{name}_norm").isNotNull())


def with_labels(df: DataFrame, labels: dict[str, dict[str, str]]) -> DataFrame:
    """Display labels; a code without a label is shown as it is."""
    for name, mapping in labels.items():
        df = df.withColumn(f"{name}_label", map_value(name, mapping, F.coalesce(F.col(name), F.lit(""))))
    return df


SHINGLE = 3


def _token_keys(tokens: Column) -> Column:
    """Hashes of every run of three tokens, or of every token if there are fewer."""
    last = F.size(tokens) - (SHINGLE - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, SHINGLE), " ")))
    return F.when(last >= 1, runs).otherwise(F.transform(tokens, lambda t: F.xxhash64(F.lit(1), t)))


SPREAD = 64  # rows that the askers of one clause are dealt to


def contained_in(clauses: DataFrame, docs: DataFrame, clause_id: str, clause_col: str, doc_id: str, text_col: str) -> DataFrame:
    """Pairs (clause, document) where the document contains the clause verbatim.

    A contained clause has all its inner tokens in the document as whole tokens, in order, so every run of three of them
    is an equality key; the one found in fewest documents is looked up, and the pair verified. Clauses with one or two
    inner tokens use these. Those without any are looked up by their first two characters (or only one) among the
    distinct characters and pairs of neighbours of the documents. Empty clauses are contained in nothing.

    Equal clauses are searched once. Their ids, as arrays, meet the documents found in the last join, whose rows are neither
    shuffled nor written: many ids may ask for one clause, and all their pairs exist only as output.
    """
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text_col).alias("_text"))
    rows = clauses.select(F.col(clause_id).alias("_id"), F.col(clause_col).alias("_clause")).where("length(_clause) > 0 and _id is not null")
    # Written tables: their sizes tell the planner which fit a broadcast, before a document is read; plain, as the keys found
    # and the ids of askers repeat and grow with the documents.
    asked = materialise(rows.select("_clause").distinct().withColumn("_n", F.monotonically_increasing_id()), "asked-clauses", plain=True)
    askers = rows.join(asked, "_clause").select("_n", "_id").distinct()
    askers = materialise(askers.groupBy("_n", F.pmod(F.xxhash64("_id"), F.lit(SPREAD)).alias("_part")).agg(F.collect_list("_id").alias("_ids")), "askers", plain=True)
    keyed = asked.withColumn("_t", simple_tokens("_clause")).withColumn("_i", F.slice("_t", 2, F.greatest(F.size("_t") - 2, F.lit(0))))
    long = materialise(keyed.where(F.size("_i") > 0).select("_n", F.explode(F.array_distinct(_token_keys(F.col("_i")))).alias("_key")), "clause-keys", plain=True)
    wanted = materialise(long.select("_key").distinct(), "asked-keys", plain=True)
    singles = F.transform(F.array_distinct("_t"), lambda t: F.xxhash64(F.lit(1), t))
    words = texts.select("_doc", simple_tokens("_text").alias("_t"))
    found = words.select("_doc", F.explode(F.array_distinct(F.concat(singles, _token_keys(F.col("_t"))))).alias("_key"))
    found = materialise(found.join(wanted, "_key", "left_semi"), "found-keys", plain=True)
    spread_of = found.groupBy("_key").agg(F.count(F.lit(1)).alias("_found"))
    rarest = long.join(spread_of, "_key", "left").groupBy("_n").agg(F.min(F.struct(F.coalesce("_found", F.lit(0)).alias("n"), "_key")).alias("_m"))
    pairs = found.join(rarest.where("_m.n > 0").select("_n", F.col("_m._key").alias("_key")), "_key").select("_n", "_doc")

    short = materialise(keyed.where(F.size("_i") == 0).select("_n", F.substring("_clause", 1, 2).alias("_key")), "short-clauses", plain=True)
    starts = materialise(short.select("_key").distinct(), "asked-starts", plain=True)
    marks = F.concat(F.split("_text", ""), F.regexp_extract_all("_text", F.lit("(?s)(?=(..))"), 1))
    seen = texts.select("_doc", F.explode(F.array_distinct(marks)).alias("_key")).join(starts, "_key", "left_semi")
    pairs = pairs.union(seen.join(short, "_key").select("_n", "_doc"))

    verified = pairs.join(asked, "_n").join(texts, "_doc").where(F.contains("_text", F.col("_clause"))).select("_doc", "_n").distinct()
    links = verified.join(askers, "_n").select(F.explode("_ids").alias(clause_id), F.col("_doc").alias(doc_id))
    repeated = rows.distinct().groupBy("_id").agg(F.count("*").alias("n")).where("n > 1")
    return links if repeated.isEmpty() else links.distinct()  # only an id with two clauses can find a document twice


def match_gold(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Expected clauses against answers of the same question: hit flag per clause."""
    hit = F.coalesce(F.contains(F.col("answer_zh"), F.col("clause")), F.lit(False))
    return gold.join(answers, "question_id", "left").withColumn("hit", hit)
