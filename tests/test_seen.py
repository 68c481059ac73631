import random

from lectern.operators import seen
from lectern.session import work_path


def urls(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "url string, pos int")


def test_two_crawls_lose_and_repeat_no_url(spark):
    rng, root, known = random.Random(4), work_path(spark, "seen"), set()
    for crawl in range(3):
        found = [f"https://h/{rng.randrange(900)}" for _ in range(600)] + [None, "https://h/ü"]
        got = seen.unseen(spark, root, urls(spark, found), bits=2048).collect()  # so small that false alarms are many
        assert sorted((r.url, r.pos) for r in got) == sorted((u, i) for i, u in enumerate(found) if u and u not in known)
        seen.note_seen(spark, root, urls(spark, found), crawl, bits=2048)
        seen.note_seen(spark, root, urls(spark, found), crawl, bits=2048)
        known |= {u for u in found if u}


def test_false_alarms_are_as_rare_as_the_size_says(spark):
    held, asked = urls(spark, [f"a{i}" for i in range(4000)]), urls(spark, [f"a{i}" for i in range(2000, 12_000)])
    n = seen.alarms(asked, held, bits=1 << 15).first()  # 8.2 bits per URL
    assert (n.n_urls, n.n_seen) == (10_000, 2000)
    assert 2000 + 0.01 * 8000 < n.n_maybe < 2000 + 0.05 * 8000
    assert seen.alarms(asked, held, bits=1 << 20).first().n_maybe <= 2001
    assert seen.alarms(asked, held.limit(0), bits=1 << 10).first().n_maybe == 0
