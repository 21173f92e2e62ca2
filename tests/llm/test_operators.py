"""Each dealt operator against a brute-force version, over odd rows and the smallest table."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import components, fingerprints, lang_id, licenses, line_dedup, packing, pieces, quality_mil, quality_rules, queries, simhash, token_files
from gleaner.llm.common import held_out, work_dir, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line int, key string, n long, word string, version long"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = "\n".join(" ".join(f"p{i}q{j}" for j in range(20)) for i in range(4))
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Same text here, with six words.\nMore."), (5, "Same text here, with six words.\nMore."), (6, LONG), (7, LONG + " changed"),
    (8, "first line\n" + PASSAGE + "\nlast"), (9, PASSAGE), (10, "other\n" + PASSAGE), (11, "a  b\n\n c\td ÀÉ 日本語 𝄞 ''s 12"), (12, "x " * 40), (13, "Released under the MIT Licence"),
    (14, "(c) 2020 someone\nReleased, under THE MIT license!!"), (14, "a second row with this id"), (15, "12345 ###"), (16, "The quick brown fox\nThe quick brown fox"),
    (50, "ends with blanks   "), (51, "\n".join(["same line again and again of ten words in all"] * 30)),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "src", 1, 2, "k", 3, "w", 4) for i, t in ODD]
    return written(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def collected(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def path(name):
    return str(public_tokenizers.path(name))


# ---- 1


@pytest.fixture(scope="module")
def model():
    return pieces.load(path("piece_bpe_32k.model"))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_sentencepiece_equals_library(which, model, request):
    import sentencepiece

    docs = request.getfixturevalue(which)
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    got = pieces.encode(docs, model).select("doc_id", "ids", pieces.decoded("ids", model).alias("t")).collect()
    want = sorted((r["doc_id"], sp.encode(r["text"] or "")) for r in docs.collect())
    assert sorted((r["doc_id"], r["ids"]) for r in got) == want
    assert sorted((r["doc_id"], r["t"]) for r in got) == sorted((r["doc_id"], r["text"] or "") for r in docs.collect())


def test_sentencepiece_forgets(documents, model, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "WORDS", 200)
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    long = documents.filter("n_chars > 2000").unionByName(documents.sparkSession.createDataFrame([(-1, "ab" * 3000 + "日本語𝄞" * 300, "", "", 1)], documents.schema))
    got = pieces.encode(long, model, most=100).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((r["doc_id"], sp.encode(r["text"])) for r in long.collect())


def test_sentencepiece_empty(empty, model):
    assert pieces.encode(empty, model).count() == 0


def test_unigram_models_are_encoded_by_best_paths(spark):
    scores = {"▁the": -1.0, "▁": -2.0, "th": -2.5, "e": -1.5, "t": -3.0, "h": -3.0, "▁t": -2.2, "he": -1.2, "▁▁": -2.1}
    model = pieces.Model([(p, i + 1, s) for i, (p, s) in enumerate(scores.items())], None, 0, 4, False)
    texts = [(1, "the the  the"), (2, "the zhe"), (2, "he"), (2, "he"), (3, None), (4, ""), (None, "é"), (5, " the ")] + [(i, "the he " * i) for i in range(10, 30)]
    got = pieces.encode(spark.createDataFrame(texts, "doc_id long, text string"), model)
    score = {i + 1: s for i, s in enumerate(scores.values())} | {0: -1e4}

    def best(s):
        top = [0.0] + [-1e18] * len(s)
        for e in range(1, len(s) + 1):
            top[e] = max([top[e - 1] - 1e4] + [top[e - n] + scores[s[e - n : e]] for n in range(1, 5) if n <= e and s[e - n : e] in scores])
        return top[-1]

    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, round(sum(score[i] for i in r["ids"]), 6)) for r in got.collect()))
    want = sorted((i is None, i or 0, round(best(BLANK_ + t.replace(" ", BLANK_)) if t else 0.0, 6)) for i, t in texts)
    assert rows == want


BLANK_ = pieces.BLANK


def test_viterbi_is_best_path(spark):
    table = [("a", 1, -1.0), ("b", 2, -1.5), ("ab", 3, -2.0), ("abc", 4, -6.0), ("c", 5, -0.5), ("bc", 6, -1.0), ("ca", 7, -0.2)]
    words = ["abc", "ab", "abab", "cabca", "xa", "axb", "x"]
    t = spark.createDataFrame(table, "piece string, id int, score double")
    got = pieces.viterbi(pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), t, 3), unknown=0)
    got = {r["word"]: r["ids"] for r in got.collect()}

    def best(w):
        if not w:
            return 0.0
        return max([s + best(w[len(p) :]) for p, _, s in table if w.startswith(p)] + [best(w[1:]) - 1e4])

    score = {i: s for _, i, s in table} | {0: -1e4}
    for w in words[:-1]:
        assert abs(sum(score[i] for i in got[w]) - best(w)) < 1e-9, (w, got[w])


# ---- 2


def version(text):
    """Spark's xxhash64 of a string, as a signed long."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_line_dedup_keeps_columns_and_first_copies(odd, empty):
    got = line_dedup.deduped(odd)
    assert got.columns[: len(odd.columns)] == odd.columns
    text = {r["doc_id"]: r["text"] for r in got.filter("doc_id <> 14").collect()}
    assert text[8] == ODD[8][1] and text[9] == "" and text[10] == "other" and text[0] is None
    assert line_dedup.deduped(empty).count() == 0


def brute_maximal(rows, min_words):
    """Every run of at least min_words words, however long, that begins at a line with words and at an earlier place too is deleted."""
    lines = {(i, version(t)): t.split("\n") for i, t in rows if t is not None}
    seen, gone = {}, defaultdict(set)
    for doc, ls in sorted(lines.items()):
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1) if ls[a].encode().split() else []:
                if sum(len(x.encode().split()) for x in ls[a:b]) >= min_words and seen.setdefault(tuple(ls[a:b]), (doc, a)) != (doc, a):
                    gone[doc] |= set(range(a, b))
    return sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, version(t)]) if t is not None else "") for i, t in rows)


def test_line_dedup_deletes_maximal_runs(spark, odd, documents):
    tail = "\n".join([" ".join(f"a{i}" for i in range(53)), "eight words that are left over here now", "one", "", ""])
    some = [(1, "first\n" + tail + "\nend"), (2, "second\n" + tail), (3, tail + "\nend"), (4, tail + "\nother"), (5, tail), (6, "x\n" + tail.replace("one", "two")), (7, tail.replace("one", "two") + "\ny")]
    rng = np.random.default_rng(2)
    mixed = [(i, "\n".join(" ".join(f"w{k}" for _ in range(k % 4)) for k in rng.integers(0, 5, 40).tolist())) for i in range(30)]
    made = [(spark.createDataFrame(rows, "doc_id long, text string"), least) for rows, least in ((some, 50), (mixed, 9))]
    for docs, least in [*made, (odd, 5), (documents, 50), (documents, 12)]:
        got = line_dedup.deduped(docs, least)
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert collected(got.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text") == brute_maximal(rows, least)
    assert {r["doc_id"]: r["text"] for r in line_dedup.deduped(made[0][0]).collect()}[3] == ""


def test_line_dedup_columns_of_its_own_names(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    rows = [(1, text, "a"), (2, "first\n" + text, "b"), (2, text, "c"), (None, text, "d"), (3, None, "e"), (4, "", "f"), (1, text, "g")]
    names = ["doc_id", "text", "runs", "_doc", "doc", "version", "n_lines", "n_removed", "line", "rank"]
    docs = spark.createDataFrame([(i, t, *[x] * 8) for i, t, x in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:]))
    got = line_dedup.deduped(docs)
    assert got.columns == ["doc_id", "text", "runs", "_doc", "doc", "version", "line", "rank", "n_lines", "n_removed"]
    assert sorted((r["runs"], r["text"], r["n_removed"]) for r in got.collect()) == [("a", text, 0), ("b", "first", 4), ("c", "", 4), ("d", text, 0), ("e", None, 0), ("f", "", 0), ("g", text, 0)]


def test_line_ranks_are_those_of_a_suffix_array(spark):
    rng = np.random.default_rng(5)
    docs = {i: [int(x) for x in rng.integers(0, 3, 40)] for i in range(12)}
    rows = [(i, 0, k, 0, 0, x, 0) for i, ls in docs.items() for k, x in enumerate(ls)]
    pairs, keys = written(spark.createDataFrame(rows, "doc_id long, version long, line int, stop int, many int, a long, b long")), ["a", "b"]
    for k in range(4):
        table = line_dedup.ranked(pairs, keys, 3)
        ranks = line_dedup.join_hot(pairs, table, keys, "n").filter("rank IS NOT NULL")
        got = {(r["doc_id"], r["line"]): r["rank"] for r in ranks.collect()}
        spans = {(i, a): tuple(ls[a : a + 2**k]) for i, ls in docs.items() for a in range(len(ls) - 2**k + 1)}
        often = {s for s, n in Counter(spans.values()).items() if n > 1}
        assert set(got) == {p for p, s in spans.items() if s in often}
        order = sorted(got, key=lambda p: (got[p], p))
        assert order == sorted(got, key=lambda p: (spans[p], p))  # the suffix array's order, at this depth
        assert all((got[p] == got[q]) == (spans[p] == spans[q]) for p, q in zip(order, order[1:]))
        pairs, keys = written(line_dedup.doubled(ranks, k, 3)).filter("depth = 0"), ["r", "other"]


# ---- 3


def test_licenses(odd, empty):
    got = collected(licenses.scan(odd), "doc_id", "line", "license")
    assert got == [(13, -1, "MIT-notice"), (13, 0, "MIT-notice"), (14, -1, "MIT-notice"), (14, 1, "MIT-notice")]
    assert licenses.documents(empty).count() == 0


def test_every_known_text_is_found(spark):
    rows = [(i, k, v) for i, (k, v) in enumerate(licenses.wordings())]
    texts = [(i, v.upper()) for i, _, v in rows] + [(1000 + i, "Copyright (c) 2020, Some Body\n" + "\n".join(v.replace("license", "licence").split())) for i, _, v in rows]
    got = licenses.documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["whole_license"] for r in got if r["whole_license"]} == {i: k for i, k, _ in rows} | {1000 + i: k for i, k, _ in rows}


def test_own_licences_need_no_cue_words(spark):
    docs = spark.createDataFrame([(1, "Take it, and be glad."), (2, "x\ntake IT and  be glad"), (None, "Take it and be glad"), (3, None), (4, "")], "doc_id long, text string")
    got = licenses.scan(docs, {"glad": "Take it and be glad"}).collect()
    assert sorted((r["doc_id"] or 0, r["line"]) for r in got) == [(0, -1), (0, 0), (1, -1), (1, 0), (2, 1)]


def test_published_files_have_the_known_digests(spark):
    import os

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0-full": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(k, open(f"{folder}/{v}").read()) for k, v in names.items() if os.path.exists(f"{folder}/{v}")]
    if not rows:
        pytest.skip("no license files on this machine")
    got = spark.createDataFrame(rows, "k string, t string").select("k", licenses.digest(F.col("t")).alias("d")).collect()
    assert all(licenses.DIGESTS[r["k"]] == r["d"] for r in got)


# ---- 4, 7


def test_attention_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, 5)).astype(np.float32) for n in (1, 3, 7, 2) * 8]
    y = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    w = quality_mil.fit_bags(bags, y, hidden=8, attention=4, epochs=150, rate=0.02, batch=8)
    got = np.array([quality_mil.score(w, b) for b in bags])
    assert ((got > 0.5) == (y == 1)).mean() > 0.9
    assert np.allclose(got, [quality_mil.score(w, b, block=2) for b in bags])


def test_quality_classifier_holds_out(spark, documents, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_mil.fit(docs, labels)
    got = quality_mil.scored(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if held_out(r["doc_id"])]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    rows = quality_mil.scored(odd, model, keep=odd.columns).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_mil.scored(empty, model).count() == 0
    assert quality_mil.fit(empty, labels) == 0.5


def brute_statistics(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_quality_rules(spark, documents, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = quality_rules.fit(docs, labels)
    for df in (odd, documents):
        got = quality_rules.judged(df, trees, keep=["doc_id", "text"]).collect()
        assert len(got) == df.count()
        for r in got:
            want = brute_statistics(r["text"] or "")
            assert [r[c] for c in quality_rules.BASE] == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r["kept"] and r["base_failed"])
    got = quality_rules.judged(docs, trees).join(labels, "doc_id").collect()
    held = [r for r in got if held_out(r["doc_id"])]
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in held]) > 0.9
    assert quality_rules.judged(empty, trees).count() == 0
    assert quality_rules.fit(empty, labels) is None


def test_trees_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 2))
    y = (x[:, 0] + 0.4 * np.sin(9 * x[:, 0]) + 0.3 * rng.random(2000) + x[:, 1] > 1).astype(float)
    t = quality_rules.fit_trees(x, y, [-1, 0])
    grid = np.linspace(0, 1, 50)
    for other in (0.1, 0.5, 0.9):
        s = t.score(np.stack([grid, np.full(50, other)], 1))
        assert (np.diff(s) <= 1e-12).all()


# ---- 5


def test_token_files(spark, odd, documents, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    for docs in (odd, documents):
        to = work_dir(spark)
        token_files.write_token_files(docs, to, path("word_bpe_49k.json"))
        got = token_files.read_token_files(spark, to).orderBy("start").collect()
        rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
        start = 0
        for (doc, text), r in zip(rows, got, strict=True):
            want = tok.encode(text, add_special_tokens=False).ids + [2]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc, start, len(want), want)
            start += len(want)
        crc = token_files.digests(token_files.read_token_files(spark, to)).orderBy("start").collect()
        assert [c["ids_crc32"] for c in crc] == [zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got]
    to = work_dir(spark)
    token_files.write_token_files(empty, to, path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, to).count() == 0


def test_token_files_of_split_tasks_and_null_ids(spark, documents):
    docs = documents.select(F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("doc_id"), "text")
    to = work_dir(spark)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        token_files.write_token_files(docs, to, path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = token_files.read_token_files(spark, to).orderBy("start").collect()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == docs.count()
    none = spark.createDataFrame([(None, f"word {i}") for i in range(9)], "doc_id long, text string")
    to = work_dir(spark)
    token_files.write_token_files(none, to, path("word_bpe_49k.json"))
    assert token_files.digests(token_files.read_token_files(spark, to)).count() == 9


def test_token_file_layout(spark, documents):
    import glob

    import pyarrow.parquet as pq

    to = work_dir(spark)
    token_files.write_token_files(documents, to, path("word_bpe_49k.json"))
    plan = token_files.read_token_files(spark, to, ["doc_id", "n_tokens"])._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[-1]
    for f in glob.glob(f"{to.removeprefix('file://')}/part-*"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            col = meta.row_group(g).column(meta.num_columns - 1)
            assert col.path_in_schema.startswith("ids") and "DELTA_BINARY_PACKED" in col.encodings
            assert col.has_offset_index and meta.row_group(g).column(0).has_column_index


# ---- 6


def brute_fingerprint(text, width):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, p in enumerate(prints):
        least[find(i)].append(p[0])
    return sorted((p[0], min(least[find(i)])) for i, p in enumerate(prints))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_simhash(which, request):
    docs = request.getfixturevalue(which)
    prints = written(simhash.fingerprints(docs, 4))
    want = sorted((r["doc_id"], brute_fingerprint(r["text"] or "", 4)) for r in docs.collect())
    assert sorted((r["doc_id"], r["fp"] % (1 << 64)) for r in prints.collect()) == want
    assert collected(simhash.groups(prints, 4), "doc_id", "component_id") == brute_groups(want, 4)


@pytest.mark.parametrize("radius", [2, 4, 8])
def test_simhash_groups_of_clusters(spark, radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    rows = []
    for k in range(1500):
        x = int(centres[k % 20 if k % 3 else 0])
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(b)
        rows.append((k, x))
    df = written(spark.createDataFrame([(k, x - (1 << 64) if x >= 1 << 63 else x) for k, x in rows], "doc_id long, fp long"))
    assert collected(simhash.groups(df, radius), "doc_id", "component_id") == brute_groups(rows, radius)


def test_simhash_empty(empty):
    assert simhash.groups(written(simhash.fingerprints(empty)), 4).count() == 0


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_copies_are_like_what_stays(which, request):
    docs = request.getfixturevalue(which)
    gone = {r["doc_id"]: r["copy_of"] for r in simhash.copies(docs).collect() }
    kept = {r["doc_id"]: r["text"] for r in simhash.deduped(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = simhash_words(r["text"] or "")
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    assert set(kept) == set(sets) - set(gone)

    def like(a, b):
        return len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] | sets[b] else 1.0

    for d in gone:
        assert any(c != d and like(d, c) >= 0.8 for c in sets)
    left = sorted(kept)
    missed = [(a, b) for k, a in enumerate(left) for b in left[:k] if sets[a] and sets[b] and like(a, b) >= 0.8]
    assert len(missed) <= 0.25 * len(gone)


def brute_gone(rows, similarity=0.8):
    """Members of the components of all pairs that are alike, but for each one's least doc_id."""
    sets = []
    for i, t in sorted(rows):
        w = simhash_words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in root if find(i) != i}


def test_copies_of_a_large_group_are_all_found(spark):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(200):
        t = list(base)
        for k in rng.integers(0, 160, rng.integers(2, 7)).tolist():
            t[k] = f"e{i}x{k}"
        rows.append((i, " ".join(t)))
    df = written(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in simhash.copies(df).collect()} == brute_gone(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_copies_leave_no_pair_alike(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert {r["doc_id"] for r in simhash.copies(docs).collect()} == brute_gone(rows)


def test_rows_of_one_doc_id_with_other_texts_are_other_documents(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + " end"), (3, c), (1, c), (None, a), (4, None), (5, ""), (5, " ")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, v long, copy_of long, node long")
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.deduped(docs).collect())
    assert left == sorted([(1, a), (1, c), (2, b), (2, b), (0, a), (4, "")])
    assert simhash.deduped(docs).columns == docs.columns


def test_passages_of_many_texts_do_not_bring_them_together(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(k, shared + " " + " ".join(f"k{k}w{i}" for i in range(60))) for k in range(150)] + [(1000 + k, shared + " " + " ".join(f"k{k}w{i}" for i in range(59))) for k in range(0, 150, 10)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in simhash.copies(docs).collect()} == brute_gone(rows)
    h = [np.unique(simhash.hashes(t, 5)) for _, t in rows]
    texts = docs.select("doc_id", F.xxhash64("text").alias("v"), "text")
    start = written(spark.createDataFrame([(i, 0, len(x), simhash.prefix_of(x, np.empty(0, np.uint64), 0.8).tolist()) for (i, _), x in zip(rows, h, strict=True)], "doc_id long, v long, size long, prefix array<long>"))
    got = simhash.rarer_prefixes(texts, start, 5, 0.8, rounds=6)
    assert got.select(F.explode("prefix").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] <= 64


def test_many_pairs_are_salted(spark, documents, monkeypatch):
    want = collected(simhash.copies(documents), "doc_id", "copy_of")
    monkeypatch.setattr(simhash, "FEW", 0)
    monkeypatch.setattr(components, "FEW", 0)
    assert collected(simhash.copies(documents), "doc_id", "copy_of") == want


def test_copies_of_one_fingerprint_but_another_head(spark):
    common = "x " * 500
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, common + a), (2, common + b), (3, common + b + " end"), (4, common + a + " end")]
    assert len({brute_fingerprint(t, 5) for _, t in rows}) == 1
    got = {r["doc_id"]: r["copy_of"] for r in simhash.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 2, 4: 1}


def simhash_words(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_thresholds_sum_and_find_all():
    cost, ts = simhash.allot([[1, 5, 20], [2, 9, 40], [100, 900, 4000]], [21, 21, 22], 2, 10)
    assert sum(ts) == 2 and len(ts) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 200) if i % 50 != 49] + [(1000, 5), (7, 7), (300, 301), (301, 302), (302, 300)]
    got = collected(components.connected_components(spark.createDataFrame(edges, "u long, v long")), "node", "root")
    root = {n: 50 * (n // 50) for n in range(200)} | {1000: 0, 300: 300, 301: 300, 302: 300}
    assert got == sorted(root.items())


# ---- 8


def check_pieces(rows, texts, capacity=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for d, got in by_doc.items():
        at = 0
        for s, n, crc, total in sorted(got):
            assert s == at and n > 0 and total == len(ids[d])
            assert crc == zlib.crc32(np.array(ids[d][s : s + n], "<u4").tobytes())
            at += n
        assert at == len(ids[d])
    waste = held = 0
    for got in by_seq.values():
        at = 0
        for o, n in sorted(got):
            assert o == at
            at += n
        assert at <= capacity
        held += at
        waste += 0 if at & (at - 1) == 0 else capacity - at
    return waste / max(1, held)


def test_packing(odd, documents, empty):
    texts = [(i, t) for i, t in ODD if i != 14]
    assert check_pieces(packing.pack(odd.filter("doc_id <> 14"), path("byte_bpe_50k.json")).collect(), texts) == 0
    assert check_pieces(packing.pack(documents, path("byte_bpe_50k.json")).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()]) == 0
    assert packing.pack(empty, path("byte_bpe_50k.json")).count() == 0


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(3)
    sizes = sorted(rng.integers(1, 1000, 300).tolist(), reverse=True)
    tree, space = packing.CapacityTree(len(sizes), 1024), [1024] * len(sizes)
    for n in sizes:
        want = next(i for i, s in enumerate(space) if s >= n)
        space[want] -= n
        assert tree.take(n) == want


# ---- 9


def test_fingerprints(odd, empty, documents):
    got = fingerprints.near(written(fingerprints.compared(odd))).collect()
    rows = sorted((i, t or "") for i, t in ODD)
    assert len(got) == len(rows)
    prints = defaultdict(set)
    want = Counter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    text = {i: t for i, t in rows if i != 14}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] != 14:
            prints[text[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    near = {r["doc_id"]: r["near_next"] for r in got}
    assert near[4] == 1 and near[0] == 1 and near[2] == 0 and near[6] > 0.9
    assert fingerprints.near(written(fingerprints.compared(empty))).count() == 0


def test_fingerprints_estimate_weighted_jaccard(spark, documents):
    got = fingerprints.near(written(fingerprints.compared(documents))).collect()
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    error = []
    for k, r in enumerate(sorted(got, key=lambda r: r["doc_id"])):
        t, nxt = rows[k][1], rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        a, b = Counter(t.split()), Counter((t[: len(t) - half] + nxt[:half]).split())
        error.append(r["near_edited"] - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.08


def test_fingerprints_of_null_sparse_and_clustered_ids(spark):
    ids = [None, None, -(1 << 62), -5, *range(0, 400), 10**9, 10**15, 10**15 + 1, (1 << 62) + 3]
    rows = [(i, f"text of {i} number {k} with some words {k % 7}") for k, i in enumerate(ids)]
    got = fingerprints.near(written(fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    assert all(r["near_next"] > 0.2 for r in got)


def brute_samples(text):
    """Each sample's winner by the plain definition: draws r, c, b of each word and sample, and the least a."""
    import math

    def h(x, seed):
        return xxhash.xxh64_intdigest(int(x).to_bytes(4, "little", signed=True), seed)

    def long_hash(x, k):
        return h(k, xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42))

    out = []
    words = {xxhash.xxh64_intdigest(w, 42): n for w, n in Counter(text.split()).items()}
    for k in range(fingerprints.SAMPLES):
        best = None
        for w, n in words.items():
            x = long_hash(w, k // 2)
            v = ((x >> 32 if k % 2 == 0 else x & 0xFFFFFFFF) + 0.5) / 2**32
            y = long_hash(w, 1000 + k)
            rest = -math.log(((y & 0x7FFFFFFF) + 0.5) / 2**31)
            a1 = -math.log(v)
            c = a1 - math.log(((y >> 33) + 0.5) / 2**31)
            r = rest - math.log(a1 / c)
            b = rest / r
            t = math.floor(math.log(n) / r + b)
            a = c * math.exp(-r * (t - b) - r)
            if best is None or a < best[0]:
                best = (a, w, t)
        out.append(best[1:])
    return out


def test_fingerprints_are_weighted_samples(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.filter("n_chars < 3000").limit(40).collect()]
    rows += [(10**6, "a a a b b c"), (10**6 + 1, "a a b b b c"), (10**6 + 2, "c b a a a b")]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: brute_samples(t) for i, t in rows}
    for (i, _), (j, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        if want[i] and want[j] and None not in (want[i][0], want[j][0]):
            same = [got[i][4 * k : 4 * k + 4] == got[j][4 * k : 4 * k + 4] for k in range(fingerprints.SAMPLES)]
            brute = [a == b for a, b in zip(want[i], want[j], strict=True)]
            assert sum(x != y for x, y in zip(same, brute, strict=True)) <= 1, (i, j)
    assert got[10**6] == got[10**6 + 2] != got[10**6 + 1]


def test_general_fingerprints_agree(odd):
    a = collected(fingerprints.fingerprints(odd), "doc_id", "fingerprint")
    assert a == collected(fingerprints.compared(odd), "doc_id", "fingerprint")


# ---- 10


def brute_profile(text, size):
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    s = " " + " ".join(s.split()) + " "
    count = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    return {g: c for g, c in count.items() if g != " " and not (len(g) == 3 and g[1] == " ")}


def test_grams_are_the_texts():
    for t in ("Ab, c dé 12 日本", "x", "the the", "É"):
        keys, n = lang_id.grams(t)
        names = {}
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            if k >> 62:
                p = [(k >> 42) & 0xFFFFF, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF]
            elif k >> 42:
                p = [(k >> 21) & 0x1FFFFF, k & 0x1FFFFF]
            else:
                p = [k]
            names["".join(chr(x) if x else " " for x in p)] = c
        assert names == brute_profile(t, 0), t


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = lang_id.fit(docs)
    assert profiles.names == ["de", "en", "es", "fr"]
    got = lang_id.predicted(docs, profiles, keep=["doc_id", "lang"]).collect()
    held = [r for r in got if held_out(r["doc_id"])]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    rows = {r["doc_id"]: r for r in lang_id.predicted(odd, profiles).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 15))
    assert lang_id.predicted(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in lang_id.predicted(odd, lang_id.fit(empty)).collect()} == {"und"}


def test_queries_are_registered(spark, sf_dir):
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


def test_a_long_run_of_equal_keys_makes_no_row_a_pair():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 1 << 63, 82, dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 15, dtype=np.uint64)])) for _ in range(300)]
    sets += [np.unique(np.append(s[:-1], rng.integers(0, 1 << 63, 3, dtype=np.uint64))) for s in sets[:20]] + [rng.integers(0, 1 << 63, 6000, dtype=np.uint64), shared]
    n = len(sets)
    node, size, label = np.arange(n), np.array([len(s) for s in sets]), np.arange(n)
    met = [cols for cols in simhash.met_in_runs(np.zeros(n, np.int64), node, size, label, 0.8)]
    assert sum(len(cols[0]) for cols in met) == n
    alike = {(a, b) for a in range(n) for b in range(a + 1, n) if (c := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - c)}
    got = [cols for cols in simhash.near_in_run(node, size, label, np.full(n, -1), [np.frombuffer(simhash.parities(s), "<u8") for s in sets], 0.8)]
    pairs = {x for cols in got for x in zip(cols[0].tolist(), cols[1].tolist(), strict=True)}
    assert len(alike) >= 20 and alike <= pairs and len(pairs) < n * (n - 1) // 20


def test_sets_of_other_sizes_are_no_pairs_of_a_long_run():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (*range(60, 100), *range(900, 3000, 50), 4)]
    sets.append(np.append(sets[41], np.uint64(5)))
    n = len(sets)
    node, size, odd = np.arange(n), np.array([len(s) for s in sets]), [np.frombuffer(simhash.parities(s), "<u8") for s in sets]
    got = [cols for cols in simhash.near_in_run(node, size, np.arange(n), np.full(n, -1), odd, 0.8)]
    assert [x for cols in got for x in zip(cols[0].tolist(), cols[1].tolist(), strict=True)] == [(41, n - 1)]


def test_places_that_differ_are_at_most_the_hashes_that_do():
    rng = np.random.default_rng(7)
    sizes = [0, 1, 16, 63, 64, 65, 300, 900, 1000, 20_000]
    a = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in sizes]
    b = [np.append(s[: len(s) - len(s) // 20], rng.integers(0, 1 << 63, len(s) // 10 + 1, dtype=np.uint64)) for s in a]
    for small in (lambda s: simhash.parities(s), lambda s: simhash.few_places(simhash.parities(s), len(s))):
        got = simhash.differing([small(s) for s in a], [small(s) for s in b])
        assert all(0 < d <= len(np.setxor1d(x, y)) for d, x, y in zip(got.tolist(), a, b, strict=True))
    assert [len(simhash.few_places(simhash.parities(s), len(s))) for s in a] == [8, 8, 8, 8, 8, 16, 64, 128, 128, 2048]
    assert simhash.differing([], []).tolist() == []


def test_pairs_of_equal_prefixes_but_other_sets_are_not_sent_on(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        low = rng.integers(0, 1 << 40, 21, dtype=np.uint64)
        for i in range(3):
            rest = rng.integers(1 << 41, 1 << 63, 79, dtype=np.uint64) if i < 2 else np.append(rows[-1][1][21:-2], rng.integers(1 << 41, 1 << 63, 2, dtype=np.uint64))
            rows.append((3 * k + i, np.unique(np.concatenate([low, rest]))))
    none = np.empty(0, np.uint64)
    table = [(i, len(s), simhash.prefix_of(s, none, 0.8).tolist(), i, simhash.parities(s)) for i, s in rows]
    prefixes = written(spark.createDataFrame(table + table[:5], "doc_id long, size long, prefix array<long>, label long, odd binary"))
    got = sorted((r["a"], r["b"]) for r in simhash.candidates(prefixes, 0.8).collect())
    assert got == [(3 * k + 1, 3 * k + 2) for k in range(40)]


def test_members_of_long_runs_meet_in_blocks_and_tables_go(spark, documents, monkeypatch):
    from pathlib import Path

    from gleaner.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    shared = " ".join(f"s{i}" for i in range(86))
    rows = [(10_000_000 + k, shared + " " + " ".join(f"k{k}w{i}" for i in range(15 - k % 3 // 2))) for k in range(60)]
    rows += [(20_000_000 + k, f"more {t}") for k, (_, t) in enumerate(rows[:10])]
    docs = written(documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")))
    want = collected(simhash.copies(docs), "doc_id", "copy_of")
    assert {20_000_000 + k for k in range(10)} <= {x[0] for x in want}
    monkeypatch.setattr(simhash, "RUN", 3)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    before = set(folder.glob("gleaner-*"))
    assert collected(simhash.copies(docs), "doc_id", "copy_of") == want
    left = [spark.read.parquet(str(p)).columns for p in set(folder.glob("gleaner-*")) - before if list(p.glob("*.parquet"))]
    assert not [c for c in left if {"prefix", "set"} & set(c)]


@pytest.mark.parametrize(("name", "leading_space"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_marks_are_pieces_of_their_own(name, leading_space):
    import random

    from gleaner.llm.tokens import PieceEncoder

    enc, rng = PieceEncoder(queries.vocabulary(name), leading_space), random.Random(1)
    texts = ["".join(rng.choice("abZéÀßÿµªºx  \n\t.,;:!?|#*$%&<>'-\"()19\u0301İΣΩあ×÷ \x85\x1c\r\0") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for t in ["word.### Word.", "It's.'s x!!\n", "\u00e9t\u00c9!? \u0130!", *texts]:
        assert enc.encode(t) == np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    enc = PieceEncoder(queries.vocabulary(name), leading_space)
    enc.encode("shea.### shea!! shea, shea")
    assert sum("shea" in piece for piece in enc) <= 1 + leading_space
