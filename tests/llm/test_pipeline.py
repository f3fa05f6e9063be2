import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from packetlog.llm import queries

from test_linededup import KEYS, brute, clean
from test_decontaminate import shingles
from test_simhash import brute_components, brute_fingerprint


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abdegiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(20)) for k in range(5)]
    lines = [say(15) for _ in range(30)]
    rows = [(k, "\n".join(rng.choice([rng.choice(lines), say(30)]) for _ in range(rng.randint(1, 6)))) for k in range(80)]
    rows += [(100 + k, rows[k][1]) for k in range(10)] + [(120, say(40) + " " + items[2][1] + " " + say(5)), (130, None), (131, "42 !!"), (132, "")]
    table = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    from packetlog.llm import common as C
    KEYS.update({r.text: r.k for r in table.select("text", C.text_hash().alias("k")).collect()})
    want = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    gone = brute(want)
    want = [(i, clean(t, gone.get((i, t), ()))) for i, t in want]
    parts = brute_components([i for i, _ in want], [brute_fingerprint(t) for _, t in want], 4)
    want = [(i, t) for (i, t), c in zip(want, parts) if i == c]
    want = [(i, t) for i, t in want if not any(len(shingles(u) & shingles(t)) >= 0.8 * len(shingles(u)) for _, u in items)]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
    found = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {i: model.encode(t) for i, t in want} and len(found) > 50
    changed = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert changed.schema == docs.schema and changed.where("n_chars <> length(text)").count() == 0


def test_registered_queries():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
