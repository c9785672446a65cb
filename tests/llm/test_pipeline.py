"""The pipeline's stages against plain Python."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tidebar.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the house river people with under morning garden while never every paper window little stone", "de": "der und nicht haus fluss leute garten während papier fenster kleine stein unter morgen immer"}


def test_language_without_labels_keeps_texts_with_letters(spark):
    """No language to learn, since all labels are null, or all labelled texts lack letters: only texts without letters go."""
    texts = [None, "", "12 34", "the house by the river", "été", "\u4e2d\u6587"]
    for labelled in ([], [(i, "123", "en", "a", 3) for i in range(50, 60)]):
        docs = spark.createDataFrame([(i, t, None, "a", 0) for i, t in enumerate(texts)] + labelled, SCHEMA)
        assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()) == [3, 4, 5]


def test_mixed_writes_the_words_taken(spark):
    """Each row has a document's words that the mix takes for at least the row's turn; null and empty texts have none."""
    rng = random.Random(4)
    texts = [None, "", " \n", "one", *[" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 300))) for _ in range(60)]]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        text = texts[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        for turn in range(1, max([p["times"] for p in r["parts"]], default=0) + 1):
            own = [w for p in r["parts"] if p["times"] >= turn for w in words[p["start"] : p["start"] + p["length"]]]
            want[r["doc_id"], text if len(own) == len(words) else " ".join(own)] += 1
    found = corpus_pipeline.mixed(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == want and len(want) > 30
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_mixed_writes_repeated_rows_as_often_as_the_mix_takes_them(spark):
    """Rows equal in id and text, with null ids and sources too: together they have what the mix takes of them, and no more."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(90)}" for _ in range(n))
    rows = [(i, text(rng.randrange(1, 200)), "en", "a", 0) for i in range(20)]
    shared = text(60)
    rows += [(100, text(50), "de", "a", 0)] * 4 + [(None, text(70), "en", None, 0)] * 3 + [(101, shared, "en", s, 0) for s in ("a", None, None)]
    texts = {(r[0], r[3]): r[1] for r in rows}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, words_taken, most = Counter(), 0, Counter()
    for r in mixing.mix_sources(docs).collect():
        own_text = texts[r["doc_id"], r["source"]]
        words_taken += r["taken"]
        for turn in range(1, max([p["times"] for p in r["parts"]], default=0) + 1):
            own = [w for p in r["parts"] if p["times"] >= turn for w in own_text.split()[p["start"] : p["start"] + p["length"]]]
            want[r["doc_id"], r["source"], " ".join(own)] += 1
    found = corpus_pipeline.mixed(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in found) == want
    assert sum(len(r["text"].split()) for r in found) == words_taken
    for r in rows:
        most[r[0], r[3]] += 3 * len(r[1].split())
    assert all(sum(len(f["text"].split()) for f in found if (f["doc_id"], f["source"]) == k) <= n for k, n in most.items())


ODD = [(1, None, "en", "a", None), (1, None, "en", "a", None), (None, "", None, None, 0), (3, " \n\t ", "de", "a", 4), (4, "same words here", "en", "a", 15), (4, "same words here", "en", "a", 15), (9, "SAME words here", "en", None, 15), (None, "same words here", "en", "b", 15), (7, "x" * 30000, "en", "b", 30000), (8, " ".join(f"w{k}" for k in range(9000)), "en", "b", 0)]
MORE = f"{SCHEMA}, kept string, keep_id string, component_id string, size string, mix_key string, nth int, copy int, text_key string"


def odd(spark):
    return spark.createDataFrame([(*r, *["z"] * 5, 1, 2, "q") for r in ODD], MORE).repartition(3)


def test_stages_of_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names, in each stage on its own; empty tables give empty ones."""
    docs = odd(spark)
    key = lambda rs: Counter((r["doc_id"], r["text"]) for r in rs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), "").count() == 0 and stage(spark, docs, "").columns == docs.columns, name
    exact = key(corpus_pipeline.without_copies(spark, docs, "").collect())
    assert exact == Counter({(1, None): 1, (3, " \n\t "): 1, (9, "SAME words here"): 1, (7, "x" * 30000): 1, (8, ODD[9][1]): 1}) or exact == Counter({(1, ""): 1, (3, " \n\t "): 1, (9, "SAME words here"): 1, (7, "x" * 30000): 1, (8, ODD[9][1]): 1})
    near = key(corpus_pipeline.without_near_copies(spark, docs, "").collect())
    assert near[1, None] == 2 and near[None, ""] == 1 and near[3, " \n\t "] == 1 and near[7, "x" * 30000] == 1 and near[8, ODD[9][1]] == 1
    assert sum(n for (_, t), n in near.items() if (t or "").lower() == "same words here") in (1, 2)  # one of the group, and its like rows
    mixed = corpus_pipeline.mixed(spark, docs, "").collect()
    assert all(len(r["text"].split()) for r in mixed) and {r["doc_id"] for r in mixed} <= {None, 4, 7, 8, 9}
    packed = corpus_pipeline.packed(spark, docs, "").collect()
    assert sum(r["doc_tokens"] for r in packed if r["start"] == 0) == sum(r["length"] for r in packed) and sum(r["start"] == 0 for r in packed) == len(ODD)
    assert corpus_pipeline.packed(spark, docs.where("false"), "").count() == 0


def test_run(spark, tmp_path):
    """Of each group (a text, its copy in capitals, a near copy) one document is left; texts without letters go; sequences are gapless."""
    rng = random.Random(6)
    rows = [(1000, None, None, None, None), (1001, "12345 678", "en", "a", 9), (1002, "", "de", "b", 0)]
    for g in range(30):
        lang = "en" if g % 2 else "de"
        words = rng.choices(WORDS[lang].split(), k=60)
        for k, text in enumerate((" ".join(words), " ".join(words).replace("s", "S"), " ".join([*words[:-1], "x"]))):
            rows.append((10 * g + k, text, lang, "ab"[g % 3 == 0], len(text)))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in found}
    assert kept <= {10 * g + 1 for g in range(30)} and len(kept) > 15
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 4096
