"""Line dedup with a fixed-depth template tree, in DataFrame operations only.

A line goes down the tree by its number of tokens and its leading tokens, digits masked, to a leaf. In a leaf a token is a
constant of its place if lines of several documents have it there; the other tokens are variable fields. Lines of a leaf
with the same constants at the same places share a template, as long as enough of the tokens after the leading ones are
constant; other lines stand for themselves. Templates found in several documents recur. A template that does not, but has all
constants of one that does save one, belongs to it (to each such). Lines of recurring templates are dropped, except in the document of
smallest id. Which lines share a template depends on the lines of their leaf that have tokens in common with them, on neither
order nor unrelated lines. Tokens are compared by 32 bits of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.session import materialise

SPACE = "[\\x20\\x09-\\x0D]+"


def masked(line: Column) -> Column:
    """Tokens joined by one space, runs of digits replaced by a mark. Patterns run only over lines that need them."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    plain = F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, "[0-9]+", "<*>")).otherwise(plain)


def marks(line: Column, depth: int) -> Column:
    """32 bits of the hash of each token after the leading ones: what lines are compared by, so that their text need not move."""
    tokens = F.split(line, " ")
    return F.transform(F.slice(tokens, depth + 1, F.greatest(F.size(tokens) - depth, F.lit(0))), lambda t: F.hash(t))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of the table has."""
    out = []
    for name in names:
        while name.lower() in (c.lower() for c in df.columns):
            name = f"_{name}"
        out.append(name)
    return out


def drop_recurring_lines(
    docs: DataFrame, depth: int = 3, similar_percent: int = 60, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows with recurring lines taken out of their text, and n_lines and n_dropped.

    A token is a constant of its place if the documents of the leaf's distinct lines that have it there add up to ``least_docs``;
    a template needs constants at ``similar_percent`` of the places after the first ``depth``. It recurs if it is found in
    ``least_docs`` documents or more. Lines are parted by \\n; lines without a token stay. All columns are kept (n_lines and
    n_dropped replace columns of these names); working columns have names of their own. Null texts stay null, empty texts
    empty, both with no line dropped. A null id ranks after all others. Rows that repeat an id count as one document. Very
    long texts are split into lines like others. An empty table gives no rows.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    lines = docs.select(key.alias("_id"), F.xxhash64(text).alias("_hash"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    lines = lines.select("_id", "_hash", "_pos", masked(F.col("_line")).alias("_mask")).where("_mask <> ''")
    count = F.length("_mask") - F.length(F.replace("_mask", F.lit(" "), F.lit(""))) + 1
    leaf, own = F.xxhash64(count, F.substring_index("_mask", " ", depth)).alias("_leaf"), F.xxhash64("_mask").alias("_own")
    docs_of = F.struct(F.col("_id").isNull(), F.col("_id"))

    # Masking is most of the work, so what it gives is written once: numbers and hashes of the tokens, without the text.
    lines = materialise(lines.select("_id", "_hash", "_pos", leaf, own, marks(F.col("_mask"), depth).alias("_marks")), "tokens")
    # Leaves of several documents: a leaf of one holds nothing that recurs. Those of several lines have something to compare.
    leaves = lines.groupBy("_leaf").agg(F.min(docs_of).alias("_low"), F.max(docs_of).alias("_high"), (F.min("_own") != F.max("_own")).alias("_several"))
    leaves = materialise(leaves.where("_low <> _high").select("_leaf", "_several"), "leaves")
    shared = lines.join(leaves, "_leaf")
    shared = materialise(shared.withColumn("_marks", F.when(F.col("_several"), F.col("_marks"))).drop("_several"), "lines")

    forms = shared.where("_marks is not null").groupBy("_leaf", "_own", "_id").agg(F.any_value("_marks").alias("_marks"))
    forms = forms.groupBy("_leaf", "_own").agg(F.least(F.count(F.lit(1)), F.lit(least_docs)).alias("_n"), F.any_value("_marks").alias("_marks"))
    forms = materialise(forms, "forms")
    places = forms.select("_leaf", "_own", "_n", F.size("_marks").alias("_rest"), F.posexplode("_marks").alias("_at", "_mark"))
    fixed = places.groupBy("_leaf", "_at", "_mark").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= least_docs).select("_leaf", "_at", "_mark")
    held = places.join(fixed, ["_leaf", "_at", "_mark"]).groupBy("_leaf", "_own", "_rest").agg(
        F.count(F.lit(1)).alias("_fixed"), F.bit_xor(F.xxhash64("_at", "_mark")).alias("_pattern"))
    held = held.where(100 * F.col("_fixed") >= similar_percent * F.col("_rest")).withColumn("_template", F.xxhash64("_leaf", "_fixed", "_pattern"))
    held = materialise(held.drop("_rest"), "held")

    template = F.coalesce("_template", F.xxhash64("_leaf", "_own"))
    shared = shared.drop("_marks").join(held.select("_leaf", "_own", "_template"), ["_leaf", "_own"], "left").select("_id", "_hash", "_pos", template.alias("_template"))
    counted = shared.select("_template", "_id").distinct().groupBy("_template").agg(F.count(F.lit(1)).alias("_docs"), F.min(docs_of).alias("_first"))
    counted = materialise(counted, "templates")
    recurs = counted.where(F.col("_docs") >= least_docs)

    # Templates that lack one constant of a recurring one, found by what its constants add up to without that.
    whole = held.join(recurs.select("_template"), "_template", "left_semi").groupBy("_template").agg(F.min(F.struct("_leaf", "_own", "_fixed", "_pattern")).alias("_w"))
    whole = whole.select(F.col("_template").alias("_of"), "_w.*")
    less = places.join(fixed, ["_leaf", "_at", "_mark"], "left_semi").join(whole, ["_leaf", "_own"])
    less = less.select("_of", "_leaf", (F.col("_fixed") - 1).alias("_fixed"), F.col("_pattern").bitwiseXOR(F.xxhash64("_at", "_mark")).alias("_pattern"))
    rare = held.join(recurs.select("_template"), "_template", "left_anti").select("_template", "_leaf", "_fixed", "_pattern").distinct()
    joined = rare.join(less, ["_leaf", "_fixed", "_pattern"]).select("_template", "_of").distinct()
    groups = recurs.select("_template", F.col("_template").alias("_of"), "_first").union(joined.join(counted, "_template").select("_template", "_of", "_first"))
    groups = materialise(groups, "groups")
    first = groups.groupBy("_of").agg(F.min("_first").alias("_first"))
    templates = materialise(groups.drop("_first").join(first, "_of").select("_template", F.col("_first")["_id"].alias("_first")), "recurring")

    dropped = shared.join(templates, "_template").where(~F.col("_id").eqNullSafe(F.col("_first")))
    dropped = dropped.groupBy("_id", "_hash").agg(F.collect_set("_pos").alias("_dropped"))

    names = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    own, near_id, near_hash, gone = fresh(docs, "_own", "_near_id", "_near_hash", "_dropped")
    dropped = dropped.toDF(near_id, near_hash, gone)
    rows = docs.withColumn(own, F.xxhash64(text))
    joined = rows.join(dropped, rows[f"`{id_col}`"].eqNullSafe(dropped[near_id]) & (rows[own] == dropped[near_hash]), "left")
    parts = F.split(text, "\n", -1)
    held = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(held, lambda i: F.get(parts, i)), "\n"))
    return joined.select(
        *(F.col(f"`{c}`") for c in names), kept.alias(text_col),
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("bigint").alias("n_dropped"))

