import random

import numpy as np

import corpus_pipeline
from tallyloom.llm import token_ids
from tallyloom.llm.common import tokenizer_path

from test_operators import brute_removed


def test_pipeline(spark, tmp_path):
    """Language ID, near-dedup, repeated passages and packing against the same steps done plainly."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioutnrsl") for _ in range(rng.randrange(3, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = [[i, " ".join(word() for _ in range(rng.randrange(30, 120))), "en", "src0"] for i in range(60)]
    for i in (5, 9, 30):
        rows[i][1] += " " + passage
    rows.append([70, rows[2][1], "en", "src1"])  # an exact copy
    rows.append([71, rows[3][1] + " extra", "en", "src1"])  # a near copy
    rows += [[72, "", "en", "src1"], [73, None, "en", "src1"], [74, "1234 5678", "en", "src1"]]  # no language
    docs = [(i, t, l, s, len(t or "")) for i, t, l, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).orderBy("sequence_id", "offset").collect()
    kept = [(i, t) for i, t, _, _ in rows if i < 70]
    texts = {i: raw.decode("utf-8", "ignore") for i, (_, _, _, raw) in brute_removed(kept, 100).items()}
    assert sum(len(t) for t in texts.values()) < sum(len(t) for _, t in kept)
    table = token_ids.IdTable(tokenizer_path("word_bpe_49k.json"))
    expected = {i: np.append(np.frombuffer(table.encode([t])[0], "<u4"), 2).tolist() for i, t in texts.items()}
    got = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == expected
