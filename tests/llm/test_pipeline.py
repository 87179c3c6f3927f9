import random
import re

import corpus_pipeline
from llm.cases import awkward, edited, empty, prose, wide

from tidemill.llm import decontam, quality, simhash, toxicity
from tidemill.llm.space import labels_of, table

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF)
        assert after.columns == docs.columns
        want = {
            "quality": lambda d: quality.classify(d, labels_of(spark, SF, "quality")).filter("keep"),
            "toxicity": lambda d: toxicity.classify(d, labels_of(spark, SF, "toxic")).filter("not toxic"),
            "near_duplicates": lambda d: simhash.groups(d).filter("keep"),
            "decontamination": lambda d: d.join(decontam.matches(d, table(spark, SF, "benchmark")), "doc_id", "left_anti"),
        }[name](at)
        assert ids(after) == ids(want) and after.count() <= at.count()
        at = after
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert {r.doc_id for r in packed.collect()} == set(ids(at))


def test_run_and_registration(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert [q for q in sorted(queries) if q.startswith("op")] and "pipeline" in queries
    assert {q.split("_")[0] for q in queries if q.startswith("op") and q[2].isdigit()} == {f"op{n}" for n in range(1, 11)}
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "n_tokens", "bin_id", "place"]


def test_awkward_and_empty_documents(spark):
    for docs in (wide(awkward(spark)), empty(spark)):
        at = docs
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
        at.collect()


def planted(folder, spark):
    """Clean texts, junk, insults, copies, near copies and benchmark passages, and labels of a half."""
    rng, rows = random.Random(5), []
    for k in range(360):
        text = prose(k, 60 + k % 90).capitalize() + "."
        if k % 6 == 1:
            text = " ".join(w + rng.choice(("***", "%%%", "$$$")) for w in text.split())
        elif k % 6 == 3:
            text = text.replace(" of ", " of idiot ").replace(" the ", " the moron scum ") + " You idiot moron scum."
        rows.append((k, text))
    clean = [k for k in range(360) if k % 6 in (0, 2, 4, 5)]
    item = prose(9_999, 20)
    copies = [(1000 + j, rows[clean[j]][1]) for j in range(20)] + [(2000 + j, edited(rows[clean[100 + j]][1], j, 0.03)) for j in range(10)]
    leaks = [(3000 + j, f"{prose(500 + j, 40)} {item} {prose(600 + j, 40)}.") for j in range(6)] + [(None, f"{prose(700, 40)} {item}.")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*rows, *copies, *leaks]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(8_888, 15))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(k, int(k % 6 != 1), int(k % 6 == 3)) for k in range(0, 360) if k % 12 < 6]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(rows), clean, copies, leaks, item


def test_planted_cases_by_brute_force(spark, tmp_path):
    rows, clean, copies, leaks, item = planted(str(tmp_path), spark)
    at = table(spark, str(tmp_path), "documents")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        kept.append({(r.doc_id, r.text) for r in at.collect()})
    quality_, toxicity_, once, clean_ = kept
    share = lambda some, ids: sum((k, rows[k]) in some for k in ids) / len(ids)
    assert share(quality_, clean) > 0.97 and share(quality_, [k for k in rows if k % 6 == 1]) < 0.1
    assert share(toxicity_, [k for k in clean if (k, rows[k]) in quality_]) > 0.97 and share(toxicity_, [k for k in rows if k % 6 == 3]) < 0.1
    pairs = lambda t: set(zip(w := re.findall(r"[a-z0-9]+", t.lower()), w[1:], strict=False))
    sets = {x: pairs(x[1]) for x in toxicity_}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])
    groups: list[set] = []
    for x in sorted(toxicity_, key=repr):
        near = [g for g in groups if any(alike(x, y) for y in g)]
        groups = [g for g in groups if g not in near] + [{x}.union(*near)]
    assert once <= toxicity_ and all(len(once & g) >= 1 for g in groups)
    assert sum(len(once & g) == 1 for g in groups) >= 0.97 * len(groups)
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    runs = {tuple(words(item)[k : k + 8]) for k in range(13)}
    leaky = {x for x in once if any(tuple(words(x[1])[k : k + 8]) in runs for k in range(len(words(x[1]))))}
    assert len(leaky) >= 6 and clean_ == once - leaky
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in clean_}
    bins: dict[int, list] = {}
    for r in packed:
        bins.setdefault(r.bin_id, []).append((r.place, r.n_tokens))
    for b in bins.values():
        end = 0
        for place, n in sorted(b):
            assert place == end
            end += n
        assert end <= 4096
