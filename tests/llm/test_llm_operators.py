"""Training-data operators against plain versions, and the edge cases each of them defines."""

import io
import random
import zipfile
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import types as T

from regulith.llm import archive, packing
from regulith.llm.block_dedup import dedup_windows
from regulith.llm.decontaminate import contaminated, drop_contaminated
from regulith.llm.graphs import Scratch, connected_components
from regulith.llm.line_templates import drop_recurring_lines
from regulith.llm.minhash import near_duplicates
from regulith.llm.perplexity import perplexity_filter
from regulith.llm.quality_rules import quality_rules
from regulith.llm.suffix_dedup import dedup_strings
from regulith.llm.toxicity import reject_toxic, score_toxicity

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
LABELS = "doc_id bigint, quality int, toxic int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, source, None if t is None else len(t)) for k, t, lang, source in rows], DOCS).repartition(3)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages and lines, runs of one word, short, empty, null and very long texts."""
    rng = random.Random(7)
    passage, line = words(rng, 80, 5000), "Contact us: " + words(rng, 8)
    out = []
    for k in range(60):
        text = words(rng, rng.randrange(5, 200))
        if k % 5 == 0:
            text = text + "\n" + passage + "\n" + words(rng, 10)
        if k % 4 == 0:
            text = line + "\n" + text
        out.append((k, text, "en" if k % 3 else "fr", "a" if k % 3 else "b"))
    base = words(rng, 120, 9000)
    for k in range(60, 75):
        changed = base.split()
        changed[rng.randrange(120)] = f"x{k}"
        out.append((k, base if k % 5 == 0 else " ".join(changed), "en", "a"))
    out += [(75, "the " * 300, "en", "a"), (76, "aaaa" * 200, None, None), (77, "", "en", "a"), (78, None, "fr", "c"), (79, " \n\t ", "en", None)]
    out += [(80, "Größe ñandú élan " * 30, "de", "c"), (81, "short text", "en", "a"), (82, "short text", "en", "b"), (83, "one", "en", "b")]
    out += [(84, " ".join([words(rng, 3000, 90000), passage]), "en", "b"), (85, "line 17 of 20\nline 18 of 21\n" * 3, "en", "c")]
    return out


EMPTY: list = []


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_repeated_strings(spark, rows):
    got = by_id(dedup_strings(table(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain.repeated_strings([r[:2] for r in rows])
    assert sum(v[1] for v in got.values()) > 1000


def test_repeated_windows(spark, rows):
    got = by_id(dedup_windows(table(spark, rows)), "n_words", "n_removed", "kept_sha256")
    assert got == plain.repeated_windows([r[:2] for r in rows])
    assert sum(v[1] for v in got.values()) > 500


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, rows, width, percent):
    got = by_id(near_duplicates(table(spark, rows), width, percent), "n_shingles", "component_id", "kept")
    assert got == plain.near_classes([r[:2] for r in rows], width, percent)
    assert len({v[1] for v in got.values()}) < len(rows)


def test_near_duplicates_in_chunks(spark, rows, monkeypatch):
    """Band keys and candidate groups beyond a task's size give the same classes."""
    from regulith.llm import minhash

    monkeypatch.setattr(minhash, "MEMBERS", 2)
    monkeypatch.setattr(minhash, "SET_BYTES", 2000)
    some = rows[55:80]
    got = by_id(near_duplicates(table(spark, some), 3, 85), "n_shingles", "component_id", "kept")
    assert got == plain.near_classes([r[:2] for r in some], 3, 85)


def test_ids_that_repeat_or_lack(spark):
    rng = random.Random(3)
    long = words(rng, 150, 9000)
    rows = [(1, long, "en", "a"), (1, long, "en", "a"), (None, long, "en", "a"), (None, "other text of some words here", None, None), (2, "brief", "en", "a")]
    docs = table(spark, rows)
    strings = sorted((str(r.doc_id), r.n_removed) for r in dedup_strings(docs).collect())
    n = len(long.encode())
    assert strings == [("1", 0), ("1", 0), ("2", 0), ("None", 0), ("None", n)]
    windows = sorted((str(r.doc_id), r.n_removed) for r in dedup_windows(docs).collect())
    assert windows == [("1", 0), ("1", 0), ("2", 0), ("None", 0), ("None", 150)]
    near = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(docs).collect())
    assert near == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True)]
    for df in (quality_rules(docs), packing.pack_documents(docs), drop_recurring_lines(docs), score_toxicity(docs, spark.createDataFrame([], LABELS)),
               perplexity_filter(docs, spark.createDataFrame([], LABELS))):
        assert df.count() == 5


def test_empty_tables(spark):
    docs, labels = table(spark, EMPTY), spark.createDataFrame([], LABELS)
    items = spark.createDataFrame([], "item_id bigint, text string")
    for df in (dedup_strings(docs), dedup_windows(docs), near_duplicates(docs), quality_rules(docs), packing.pack_documents(docs), drop_recurring_lines(docs),
               score_toxicity(docs, labels), perplexity_filter(docs, labels), contaminated(docs, items), archive.archive_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string"))):
        assert df.count() == 0


def test_columns_of_clashing_names(spark, rows):
    """Columns named like results or working columns change nothing."""
    docs = table(spark, rows[:30])
    more = docs
    for name in ("id", "n", "node", "kept", "score", "batch", "payload", "marks", "bucket", "_id", "_hash", "_label", "_own", "_near_id", "_dropped", "n_lines", "shard", "item", "h", "g"):
        more = more.withColumn(name, docs["source"])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(30)], LABELS)
    for run in (dedup_strings, dedup_windows, near_duplicates, quality_rules, packing.pack_documents, lambda d: score_toxicity(d, labels), lambda d: perplexity_filter(d, labels)):
        assert sorted(map(str, run(more).collect())) == sorted(map(str, run(docs).collect()))
    kept = drop_recurring_lines(more)
    assert sorted(kept.columns) == sorted({*more.columns, "n_dropped"})
    assert by_id(kept, "text", "n_dropped") == by_id(drop_recurring_lines(docs), "text", "n_dropped")


def test_quality_rules(spark, rows):
    got = by_id(quality_rules(table(spark, rows)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {k: plain.base_counts(t) for k, t, _, _ in rows}


def test_divergence_rejects_what_differs(spark):
    rng = random.Random(5)
    rows = [(k, words(rng, 120, 60), "en", "a") for k in range(200)]
    rows += [(200, " ".join(f"{w}%%%" for w in words(rng, 120, 60).split()), "en", "a"), (201, " ".join(f"zq{rng.random()}" for _ in range(120)), "en", "a"), (202, "w1 w2", "en", "a")]
    out = {r.doc_id: r for r in quality_rules(table(spark, rows)).collect()}
    assert all(out[k].kept for k in range(200))
    assert not out[200].kept and not out[201].kept and not out[202].kept
    assert out[202].js_chars is None and out[202].base_failed


def test_many_languages_take_several_passes(spark, monkeypatch):
    from regulith.llm import quality_rules as module

    rows = [(k, " ".join(f"l{k % 9}x{j % 30}" for j in range(k, k + 60)), f"l{k % 9}", "a") for k in range(45)]
    docs = table(spark, rows)
    whole = by_id(module.quality_rules(docs), "js_chars", "js_words", "kept")
    monkeypatch.setattr(module, "LANGUAGES", 4)
    assert by_id(module.quality_rules(docs), "js_chars", "js_words", "kept") == whole


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(1500):
        bad = k % 5 == 0
        text = words(rng, 60, 800).split()
        if bad:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["vile", "Rotten,", "nasty"])
        rows.append((k, " ".join(text), "en", "a"))
        labels.append((k, 1, int(bad)))
    rows += [(1500, None, None, None), (1501, "", "en", "a")]
    docs, known = table(spark, rows), spark.createDataFrame(labels + [(3, 1, None)], LABELS)
    out = {r.doc_id: r for r in score_toxicity(docs, known).collect()}
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in out)
    held = [k for k in range(1500) if out[k].held_out]
    assert sum(out[k].predicted == int(k % 5 == 0) for k in held) / len(held) > 0.97
    assert out[1500].predicted == out[1501].predicted == 0 and 0 <= out[1500].score < 0.5
    assert {r.doc_id for r in reject_toxic(docs, known).collect()} == {k for k in out if out[k].predicted == 0}


def test_contaminated(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice(["the", "sum", "of", "angles", "Étude", "is", "ninety", "degrees", "find", "root"]) + str(rng.randrange(50)) for _ in range(25))) for i in range(6)]
    items += [(6, ""), (7, None), (8, "tiny"), (None, items[0][1] + " and more words follow here")]

    def damaged(text, n):
        chars = list(text)
        for _ in range(n):
            at = rng.randrange(len(chars))
            chars[at] = rng.choice(["", "q", chars[at] + "z"])
        return "".join(chars)

    rows = []
    for k in range(48):
        body = words(rng, 60, 3000)
        if k % 2 == 0:
            i = (k // 2) % 6
            body += " " + (damaged(items[i][1], k // 4) if k % 3 else items[i][1].upper().replace(" ", "  -- ")) + ". " + words(rng, 20, 3000)
        rows.append((k, body, "en", "a"))
    rows += [(48, None, None, None), (49, "", "en", "a")]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in contaminated(docs, bench).collect()}
    want = {}
    for k, text, _, _ in rows:
        for i, item in items:
            fold = plain.folded(item or "")
            budget = min(int(len(fold) * 0.08), max(len(fold) // 10 - 1, 0))
            if len(fold) >= 10 and text:
                edits = plain.least_edits(fold, plain.folded(text))
                if edits <= budget:
                    want[k, i] = edits
    assert set(got) == set(want) and len(want) > 20
    assert all(got[k] >= want[k] for k in got)
    assert {r.doc_id for r in drop_contaminated(docs, bench).collect()} == {r[0] for r in rows} - {k for k, _ in want}


def test_items_in_blocks(spark, monkeypatch):
    from regulith.llm import decontaminate

    items = [(i, f"number {i} asks for the value of term {i * 7} in the series of {i * 13} parts") for i in range(12)]
    docs = table(spark, [(k, "Before. " + items[k][1] + " after it all.", "en", "a") for k in range(12)])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == whole >= {(k, k) for k in range(12)}


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(2)
    for _ in range(30):
        pieces = [(rng.randrange(1, 60), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, 1, 2, 3, 4, 5])) for _ in range(120)]
        pieces.sort(key=lambda p: -p[0])
        assert packing.best_fit(pieces, 64) == plain.best_fit(pieces, 64)


def test_packing(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 20)
    out = packing.pack_documents(table(spark, rows), capacity=256).collect()
    size = {k: len(plain.WORD.findall(t or "")) for k, t, _, _ in rows}
    assert {k: sum(r.n_words for r in out if r.doc_id == k) for k in size} == size
    bins = {}
    for r in out:
        assert (r.bin_id is None) == (size[r.doc_id] == 0)
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    source, text = {r[0]: r[3] for r in rows}, {r[0]: plain.WORD.findall(plain.lowered(r[1] or "")) for r in rows}
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert sum(r.n_words for r in held) <= 256
        assert [r.bin_offset for r in held] == [sum(x.n_words for x in held[:i]) for i in range(len(held))]
        for i, r in enumerate(held):
            for s in held[:i]:
                assert source[r.doc_id] is None or source[r.doc_id] != source[s.doc_id]
                assert text[r.doc_id] != text[s.doc_id]


def test_perplexity_is_that_of_the_plain_model(spark):
    rng = random.Random(4)
    rows = [(k, words(rng, 25, 40), "en" if k % 2 else "de", "a") for k in range(60)] + [(60, "?!#" * 40, "en", "a"), (61, None, "en", "a"), (62, "", None, "a"), (63, words(rng, 20, 40), None, "a")]
    labels = [(k, 1, 0) for k in range(50)]
    from regulith.llm.kernel import mix

    train = [t for k, t, _, _ in rows if k < 50 and int(mix(np.array([k], np.uint64))[0]) % 5]
    p = plain.kneser_ney(train, 3)
    out = {r.doc_id: r for r in perplexity_filter(table(spark, rows), spark.createDataFrame(labels, LABELS), order=3).collect()}
    for k in (0, 7, 55, 60, 63):
        raw = bytes(2) + rows[k][1].encode()
        logs = [np.log(p(raw[i : i + 3])) for i in range(len(raw) - 2)]
        assert out[k].perplexity == pytest.approx(np.exp(-np.mean(logs)), rel=1e-4)
    assert out[61].perplexity is None and not out[61].kept and not out[62].kept
    assert not out[60].kept and out[63].kept and out[63].threshold is not None
    assert sum(out[k].kept for k in range(60)) >= 54


PAGES = "page_id bigint, url string, html string"


def test_archive_round_trip(spark, tmp_path):
    pages = [(3, "http://a/x", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "http://a/é y\n", "Größe\r\n\r\nzwei"), (None, "u", "<p>one</p>"), (5, "v", None), (6, "w", ""), (7, "x", "z" * 300_000)]
    path = f"file://{tmp_path}/all"
    archive.write_archives(spark.createDataFrame(pages, PAGES).repartition(3), path)
    out = {r.page_id: r for r in archive.read_archives(spark, path, payloads=True).collect()}
    assert len(out) == 7
    for key, _, html in pages:
        raw = (html or "").encode()
        assert (out[key].payload_bytes, out[key].payload_digest) == (len(raw), archive.payload_digest(raw))
        assert out[key].record_type == ("revisit" if key in (3, None, 6) else "response")
        assert out[key].payload == (None if key in (3, None, 6) else raw)
    assert (out[3].refers_to, out[None].refers_to, out[6].refers_to, out[1].refers_to) == (1, 1, 5, None)
    few = f"file://{tmp_path}/few"
    archive.write_archives(spark.createDataFrame(pages, PAGES), few, least_bytes=11)
    assert {r.record_type for r in archive.read_archives(spark, few).collect()} == {"response"}


def test_zip64_directory(monkeypatch):
    """Sizes and places that only the 64-bit records hold are read."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    records = [({"id": k}, archive.gzip.compress(archive.record(k, f"http://a/{k}", b"x" * 50 * k, None, archive.RESPONSE))) for k in range(20)]
    raw = archive.package(records)
    assert archive.END64 in raw and archive.LOCATOR64 in raw
    out = [row for batch in archive.records_of(lambda at, n: raw[at : at + n], len(raw), True) for row in batch.to_pylist()]
    assert [r["page_id"] for r in out] == list(range(20)) and out[7]["payload"] == b"x" * 350


def test_broken_packages_are_told():
    with pytest.raises(ValueError, match="end of central"):
        archive.directory(lambda at, n: b"x" * n, 500)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(archive.INDEX, "{}")
    raw = out.getvalue()
    read = lambda at, n: raw[at : at + n]
    with pytest.raises(ValueError, match="compressed"):
        archive.stored_at(read, archive.directory(read, len(raw))[archive.INDEX])


def test_line_templates(spark):
    rows = [
        (1, "Page 1 of 9 in the guide\nown line of the first\n", "en", "a"), (2, "Page 22 of 9 in the guide\nanother line stands here", "en", "a"),
        (3, "text of three\nPage 3 of 9 in a guide", "en", "a"), (4, "Page 3 of 9 in the guide\nPage 4 of 9 in the guide", "en", "a"),
        (5, None, "en", "a"), (6, "", "en", "a"), (7, " \n", "en", "a"), (8, "Page one differs in most other", "en", "a"),
    ]
    out = by_id(drop_recurring_lines(table(spark, rows)), "text", "n_lines", "n_dropped")
    assert out == {
        1: (rows[0][1], 3, 0), 2: ("another line stands here", 2, 1), 3: ("text of three", 2, 1), 4: ("", 2, 2),
        5: (None, 0, 0), 6: ("", 1, 0), 7: (" \n", 2, 0), 8: (rows[7][1], 1, 0),
    }
    plan = drop_recurring_lines(table(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 201), (201, 200)] + [(300 + rng.randrange(50), 300 + rng.randrange(50)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got, _ = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {(r.node, r.component) for r in got.collect()} == {(x, root(x)) for x in linked}
