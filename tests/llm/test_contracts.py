"""Cases that every operator and stage has a defined result for, and recall at the registered settings."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import chat, common, counts, embeddings, fingerprints, id_files, language, minhash, packing, pieces, repeats
from tallyloom.llm.queries import QUERIES

from test_operators import brute_components

CLASHING = ("id", "kept", "n", "key", "node", "start", "size", "doc", "_key", "_row", "carried", "language", "confidence", "n_trigrams", "rejected", "n_bytes", "component_id", "spans", "vector", "rank")


def widened(df):
    """Extra columns named as the operators name their own."""
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING if c not in df.columns])


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioutnrsl") for _ in range(rng.randrange(3, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, say(40), "en", "s", 0) for i in range(24)]
    rows += [(3, say(30), "en", "s", 0), (None, say(30), "en", None, 0), (None, None, None, None, None), (40, "", "en", "s", 0), (41, None, "en", "s", None)]
    rows += [(50, rows[0][1], "en", "s", 0), (50, rows[0][1], "en", "s", 0), (51, say(60_000), "en", "s", 0)]  # copies, a repeated row, a very long text
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


RUNS = {
    "op1": lambda df: packing.pack_documents(df),
    "op3": lambda df: repeats.remove_repeats(df),
    "op4": lambda df: language.identify_languages(df, np.full((4, language.BUCKETS), -math.log(language.BUCKETS), np.float32)),
    "op5": lambda df: fingerprints.compare_with_next(df),
    "op6": lambda df: counts.count_tokens(df),
    "op8": lambda df: minhash.near_duplicates(df),
    "op10": lambda df: pieces.decode_pieces(pieces.encode_pieces(df)),
}


@pytest.mark.parametrize("name", RUNS)
def test_clashing_columns_odd_rows_and_empty_tables(spark, documents, name):
    """The same result with and without clashing columns; a row for every row, null and repeated ids and the long text too; nothing of nothing."""
    plain, wide = RUNS[name](documents), RUNS[name](widened(documents))
    columns = [c for c in plain.columns if c not in ("doc_id", "text", "lang", "source", "n_chars", "sequence_id", "offset", "start", "length", "ids")]
    shown = lambda df: sorted(map(str, df.select(*columns).collect()))
    if name != "op1":
        assert shown(plain) == shown(wide) and plain.count() == documents.count()
    else:
        assert wide.groupBy().sum("length").first() == plain.groupBy().sum("length").first()
    assert RUNS[name](documents.limit(0)).count() == 0


def test_odd_rows_through_id_files(spark, documents):
    path = id_files.new_path(spark)
    id_files.write_ids(widened(documents), path)
    rows = id_files.document_checksums(id_files.read_pieces(spark, path)).collect()
    assert len(rows) == documents.count() and sum(r["id"] is None for r in rows) == 2
    empty = id_files.new_path(spark)
    id_files.write_ids(documents.limit(0), empty)
    assert id_files.document_checksums(id_files.read_pieces(spark, empty)).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_with_clashing_columns(spark, documents, stage):
    """Stages keep every column as it is, whatever it is called, and pass an empty table on."""
    name, run = corpus_pipeline.STAGES[stage]
    wide = widened(documents)
    out = run(spark, wide, "")
    assert run(spark, wide.limit(0), "").count() == 0
    if name != "packing":
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in CLASHING if c not in documents.columns)
        kept = {"language ID": 29, "near-dedup": 30, "repeated passages": 32}[name]  # without 3 texts that are empty; without 2 copies; all
        assert len(rows) == kept
    else:
        assert out.where("doc_id IS NULL").select(F.sum("length")).first()[0] > 30


def test_chat_with_extra_columns(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "yes"), (None, 0, "user", "x"), (2, 0, "assistant", "w " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = df.select("*", *[F.lit(1).alias(c) for c in ("conv", "window", "tokens", "loss_starts")])
    found = [sorted(map(str, chat.conversation_digests(chat.format_conversations(x)).collect())) for x in (df, wide)]
    assert found[0] == found[1] and len(found[0]) == 3
    windows = chat.format_conversations(df).collect()
    digest = {r["conv"]: r["formatted_chars"] for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert all(digest[c] == sum(len(w["text"]) for w in windows if w["conv"] == c) for c in digest)


def test_vectors_in_double_precision(spark):
    """Doubles keep their range and precision; extra columns, null ids, an empty table."""
    rows = [(1, [1e-60, 0.0]), (2, [1e60, 0.0]), (3, [3.0, 0.0]), (4, [1e200, 1e200]), (5, [1e-200, 1.0000001e-200]), (6, [0.0, -2.0]), (7, [float("inf"), 1.0]), (8, [0.0, 0.0]), (None, [5.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("id"), F.lit(2).alias("vector"), F.lit(3).alias("node"))
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.link_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), None: (3, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7), 8: (0, 8)}
    assert embeddings.link_vectors(df.limit(0)).count() == 0


def test_vector_recall_at_the_threshold(spark, tmp_path):
    """Pairs at cosine 0.9005, the registered query: at least 0.99 of them linked, no pair below the threshold."""
    rng = np.random.default_rng(21)
    a = rng.standard_normal((1500, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9005 * a + math.sqrt(1 - 0.9005**2) * side
    v = np.concatenate([a, b]).astype(np.float32)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = {r["vec_id"]: r for r in QUERIES["op2_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    assert sum(r["n_links"] for r in rows.values()) >= 0.99 * close.sum()
    assert all(rows[i]["n_links"] <= close[i].sum() for i in rows)


def test_near_duplicate_recall_at_the_threshold(spark, tmp_path):
    """Pairs that share 80 of 100 four-word shingles, the registered query: at least 0.99 linked; those that share 79 are not."""
    rng = random.Random(22)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(400):
        common_words = fresh(83)
        rows += [(4 * k, [*common_words, *fresh(10)]), (4 * k + 1, [*common_words, *fresh(10)])]
        other = fresh(82)
        rows += [(4 * k + 2, [*other, *fresh(10)]), (4 * k + 3, [*other, *fresh(11)])]
    spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["component_id"] for r in QUERIES["op8_minhash_near_dedup"](spark, str(tmp_path)).collect()}
    assert sum(got[4 * k + 1] == 4 * k for k in range(400)) >= 396
    assert all(got[4 * k + 2] == 4 * k + 2 and got[4 * k + 3] == 4 * k + 3 for k in range(400))


def test_large_regions_in_blocks(spark):
    """Many near copies and many texts that share their opening, in blocks of few rows and few bytes."""
    rng = random.Random(23)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(80)] = f"x{rng.randrange(500)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    roots = brute_components(sets, [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    for block, size in ((256, 4 << 20), (7, 4 << 20), (256, 3000)):
        got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(df, block=block, block_bytes=size).collect()}
        assert got == roots


def test_language_against_plain_bayes(spark):
    """Scores of every row by plain Python: text, declaration, and priors of host, suffix and all rows without the row itself."""
    rng = random.Random(24)
    stems = {"en": ["the", "shore", "king"], "fr": ["leau", "été", "vous"], "de": ["über", "schön", "der"], "es": ["señor", "ción", "para"]}
    langs = list(language.LANGUAGES)
    rows = []
    for i in range(160):
        told = rng.choice([*langs, None, "xx"])
        text = " ".join(rng.choice(stems[rng.choice(langs) if rng.random() < 0.4 else told if told in stems else "en"]) for _ in range(rng.randrange(0, 9)))
        rows.append((i, text, told, rng.choice(["a.fr", "b.fr", "c.de", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("suffix", F.regexp_extract("source", r"([^.]+)$", 1))
    model = language.fit_text_model(df, sample=1000)
    got = {r["doc_id"]: r for r in language.identify_languages(df, model, suffix_col="suffix").collect()}

    def bucket(a, b, c):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
        return ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16

    def odds(text):
        points = [32, *(ord(c) if c.isalpha() else 32 for c in text.lower()), 32]
        return [bucket(*points[k - 1 : k + 2]) for k in range(1, len(points) - 1) if points[k] != 32]

    suffix = lambda h: h and h.rsplit(".", 1)[1]
    for i, text, told, host in rows:
        grams = odds(text)
        assert got[i]["n_trigrams"] == len(grams)
        if not grams:
            assert got[i]["rejected"] and got[i]["language"] is None
            continue
        others = [r for r in rows if r[0] != i]
        count = lambda rs: collections.Counter(r[2] for r in rs if r[2] in langs)
        everywhere, by_suffix, by_host = count(others), count(r for r in others if suffix(r[3]) == suffix(host)), count(r for r in others if r[3] == host)
        scores = []
        for k, name in enumerate(langs):
            p = (everywhere[name] + 1.0) / (sum(everywhere.values()) + 4.0)
            p = (by_suffix[name] + 50 * p) / (sum(by_suffix.values()) + 50)
            p = p if host is None else (by_host[name] + 20 * p) / (sum(by_host.values()) + 20)
            said = 0.9 if told == name else 0.1 / 3 if told in langs else 1.0
            scores.append(0.25 * sum(float(model[k][g]) for g in grams) + math.log(said) + math.log(p))
        scores.append(0.25 * -math.log(language.BUCKETS) * len(grams) + math.log(0.001))
        best = max(scores)
        assert got[i]["confidence"] == pytest.approx(1 / sum(math.exp(s - best) for s in scores), rel=1e-3)
        if sorted(scores)[-2] < best - 1e-3:
            assert got[i]["rejected"] == (scores.index(best) == 4) and (got[i]["rejected"] or got[i]["language"] == langs[scores.index(best)])


def test_pages_without_evidence(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://x.example.de/", None), (4, None, "<html lang=de><p>der</p>"), (4, None, "<html lang=de><p>der</p>")]
    pages = language.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string"))
    model = np.full((4, language.BUCKETS), -math.log(language.BUCKETS), np.float32)
    decide = lambda df: language.identify_languages(df, model, declared_col="declared", host_col="host", suffix_col="suffix")
    got = sorted((r["page_id"], r["host"], r["declared"], r["rejected"]) for r in decide(pages).where("page_id < 4").collect())
    assert got == [(1, None, None, True), (2, None, None, True), (3, "x.example.de", None, True)]
    assert decide(pages).where("page_id = 4 AND language = 'de'").count() == 2 and decide(pages.limit(0)).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster():
    from tallyloom.sources import shared

    unset = type("Unset", (), {"sc": lambda self: self, "getCheckpointDir": lambda self: self, "isDefined": lambda self: False})()

    class Context:
        master = "spark://host:7077"
        _jsc = unset

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_scratch_frees_what_it_made(spark):
    kept = []
    with common.scratch(lambda: kept):
        first = common.materialize(spark.range(5), "first")
        kept.append(common.materialize(first, "second"))
    exists = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df._tallyloom_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(df._tallyloom_path))
    assert not exists(first) and exists(kept[0]) and kept[0].count() == 5
