"""The pipeline against its stages done by hand."""

import random
from collections import Counter, defaultdict

from llm_rows import rows
from test_jaccard import components, words

import corpus_pipeline
from lectern.llm import langid, sharding


def corpus():
    rng = random.Random(21)
    tongues = {
        "en": "the and of to in that was with house water green stone winter letter under river".split(),
        "de": "der und von zu im dass war mit haus wasser grün stein winterzeit brief unter fluss".split(),
    }
    made, items = [], []
    for k in range(6):
        items.append(" ".join(rng.choices(tongues["en"], k=25)))
    for i in range(160):
        lang = "en" if i % 3 else "de"
        text = rng.choices(tongues[lang], k=rng.randint(20, 120))
        if i % 10 == 0 and made:
            text = made[-1][1].split() + ["more"]
            lang = made[-1][2]
        if i % 17 == 0:
            text[10:10] = items[i % 6].split()
        made += rows(" ".join(text), lang=lang, source=rng.choice("abc"), first=i)
    return made + rows(None, "", "12 34", first=160), items


def test_stages_by_hand(frame, spark, tmp_path):
    made, items = corpus()
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(made).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    classify = langid.classifier(langid.fit(docs))
    named = stages["language_id"](spark, docs, str(tmp_path))
    kept = [m for m in made if classify(m[1])[3]]
    assert ids(named) == [m[0] for m in kept] and len(kept) > 150

    single = stages["jaccard_join"](spark, named, str(tmp_path))
    roots = components([words(m[1]) for m in kept])
    kept = [kept[i] for i in sorted(set(roots))]
    assert ids(single) == [m[0] for m in kept]

    clean = stages["decontamination"](spark, single, str(tmp_path))
    kept = [m for m in kept if not any(x in m[1] for x in items)]
    assert ids(clean) == [m[0] for m in kept]

    mixed = stages["mixing"](spark, clean, str(tmp_path))
    times = Counter(ids(mixed))
    assert max(times.values()) <= 2 and set(times) <= {m[0] for m in kept}
    size, taken = defaultdict(int), defaultdict(int)
    for m in kept:
        size[m[3]] += len(m[1].split())
        taken[m[3]] += times[m[0]] * len(m[1].split())
    total = sum(size.values())
    assert abs(sum(taken.values()) - 1.5 * total) < 0.1 * total

    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == [c for c in docs.columns if c != "shard"] + ["shard"]
    got = final.collect()
    assert sorted(r.doc_id for r in got) == sorted(times.elements())
    groups = Counter(len(r.text.encode()) + 8 for r in got)
    assert sum(k * n for k, n in groups.items()) == sum(len(r.text.encode()) + sharding.OVERHEAD for r in got)
    place = {}
    assert all(place.setdefault(r.text, r.shard) == r.shard and 0 <= r.shard < 24 for r in got)
