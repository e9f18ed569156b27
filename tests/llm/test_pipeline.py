import re

import corpus_pipeline as P
from corpuslens.llm import packing
from corpuslens.llm.common import stored


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_stages(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    text = lambda seed, n=80: " ".join(f"wort{'abcdefghij'[(seed * 7 + i * i) % 10]}{'klmnopqrst'[(seed + i * 3) % 10]}{'uvwxyz'[(i * seed) % 6]}{seed}x{i}" for i in range(n))
    passage = text(99, 55)
    leak = " ".join(f"bench{i}" for i in range(14))
    rows = [
        (1, text(1)), (2, text(1)), (3, text(1).replace("x40 ", "x40y ")), (4, text(4) + " " + passage), (5, passage + " " + text(5)), (6, text(6) + " " + leak.upper()), (7, None), (8, " 123 "), (9, text(9)),
    ]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 2}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        now = stored(stage(spark, now, str(tmp_path)), name)
        kept[name] = {r[0]: r for r in now.collect()}
        if name != "packing":
            assert now.columns == docs.columns and now.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert set(kept["language_id"]) == {1, 2, 3, 4, 5, 6, 9}
    assert set(kept["near_duplicates"]) == {1, 4, 5, 6, 9}
    left = kept["substring_dedup"]
    assert left[4].text == " ".join(words(text(4))) and left[5].text == text(5) and left[5].n_chars == len(text(5)) and left[9].text == text(9)
    assert set(kept["decontamination"]) == {1, 4, 5, 9}
    encode = packing.encoder(*packing.default_paths())
    assert sum(r.length for r in now.collect()) == sum(len(encode(left[i].text)) + 1 for i in (1, 4, 5, 9))
    whole = P.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, now.collect()))


def test_small_table(spark, small):
    out = P.queries()["pipeline"](spark, small)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_edges(spark, tmp_path):
    """Nulls in every column, an id twice, very long texts, extra columns with names that operators use, no benchmark, no documents."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, place int, hits string, node long, kept_text string, _id long, cls string, _mark long, component_id long, n_removed int"
    words = lambda seed, n: " ".join(f"{'abcdefghij'[(seed + i) % 10]}{'klmnopqrst'[(seed * 3 + i * i) % 10]}{'uvwxyz'[i % 6]}{'aeiou'[(i + seed) % 5]}n" for i in range(n))
    own = [(1, words(1, 90), "xx", "a"), (2, words(1, 90), None, None), (None, words(5, 80), "xx", "b"), (None, None, None, None), (3, "", "xx", "a"), (4, words(4, 40_000), "xx", "a"), (5, words(7, 60), "xx", "c"), (5, words(9, 60), "xx", "c"), (6, "z", "xx", "c")]
    docs = spark.createDataFrame([(*r, None, 1, "clash", 2, "clash", 3, "clash", 4, 5, 6) for r in own], schema)
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, run in P.STAGES:
            now = stored(run(spark, now, folder), stage)
            if stage != "packing":
                assert now.columns == docs.columns and now.dtypes == docs.dtypes
                kept = now.collect()
            if name == "some" and stage == "language_id":
                assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "4", "5", "5", "6", "None"] and {r.lang for r in kept} == {"xx"}
            if name == "some" and stage == "near_duplicates":
                assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "6", "None"] and all(r.hits == r.cls == "clash" for r in kept)
        assert (now.count() > 0) == (name == "some")
