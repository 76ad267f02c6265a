import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from strandloom.llm import bpe, minhash_dedup, quality
from strandloom.llm.shingles import shingle_set, words_of
from tests.llm.test_operators import DOCS, brute_groups, brute_lines, words


def test_stages_are_brute_force_one_after_the_other(spark, tmp_path):
    rng = random.Random(1)
    item = " ".join(words(5, 20))
    line = "A line that is long enough to be counted by the rule."
    docs, labels = [], []
    for i in range(260):
        good = rng.random() < 0.75
        w = words(i if i % 10 else 1, 60)
        if i % 10 == 0 and i:
            w[rng.randrange(60)] = "changed"
        text = " ".join(w if good else [x.upper() + "$$" for x in w])
        docs.append((i, f"{line}\n{text}" + (f"\n{item}" if i % 13 == 5 else ""), "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good)))
    docs += [(900, None, "en", None, None), (901, "", None, "s", 0)]
    docs = spark.createDataFrame(docs, DOCS)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "tokens"]
    here, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, here, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        here = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r for r in here.collect()})
    kept, lines, near, clean, tokens = seen

    known = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scores = {r.doc_id: r["__score"] for r in quality.score(docs, known).collect()}
    assert set(kept) == {i for i, s in scores.items() if s >= quality.KEEP} and 150 < len(kept) < 230
    want = {i: t for i, _, _, t in brute_lines([(i, r.text) for i, r in kept.items()])}
    assert {i: r.text or "" for i, r in lines.items()} == want
    assert all(r.n_chars == len(r.text) for r in lines.values() if r.text is not None)
    groups = brute_groups([(i, r.text) for i, r in lines.items()], minhash_dedup.Plan())
    assert set(near) == {i for i, (_, g) in groups.items() if i == g} and len(near) < len(lines)
    wanted = set(shingle_set(words_of(item, False), 5).tolist())
    share = {i: len(wanted & set(shingle_set(words_of(r.text, False), 5).tolist())) / len(wanted) for i, r in near.items()}
    assert set(clean) == {i for i, s in share.items() if s < 0.8} and len(clean) < len(near)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCAB)), special_tokens={}
    )
    assert set(tokens) == set(clean) and all(r.round_trip for r in tokens.values())
    for i, r in tokens.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(clean[i].text or "")
    run = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {i: bytes(r.ids) for i, r in tokens.items()}
