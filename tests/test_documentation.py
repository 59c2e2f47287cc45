"""Pruning over modules, shortened inheritance and pinned templates against scans and walks, one by one."""

import random

from docgraph.operators import docs

DOCS = "symbol bigint, module int, pos bigint, origin bigint, comment string"


def brute_package(rows):
    comments, pruned = {}, 0
    module = {r[0]: r[1] for r in rows}
    for symbol, culture, _, origin, comment in sorted(rows, key=lambda r: r[2]):
        if comment is None and origin is None:
            continue
        if comment is not None and origin is not None and module.get(origin, culture) != culture and comments.get(origin, (0, None))[1] == comment:
            comments[symbol] = (origin, None)
            pruned += 1
        else:
            comments[symbol] = (origin, comment)
    shortened = dropped = 0
    kept = {}
    for symbol, (origin, comment) in comments.items():
        skipped, at, walked = 0, origin, {symbol}
        while comment is None and at in module:
            if at in walked or at not in comments:
                at = None
                break
            walked.add(at)
            if comments[at][1] is not None:
                break
            skipped, at = skipped + 1, comments[at][0]
        if comment is None and at is None:
            dropped += 1
        else:
            shortened += skipped if comment is None else 0
            kept[symbol] = (at if comment is None else origin, comment)
    return kept, {"pruned": pruned, "shortened": shortened, "dropped": dropped}


def test_package_comments(spark):
    for seed in range(3):
        r = random.Random(seed)
        n = 60
        places = r.sample(range(n), n)
        rows = [(i, i % 4, places[i], r.choice([None, r.randrange(n), r.randrange(n), 900 + i % 3]), r.choice([None, "a", "a", "b"])) for i in range(n)]
        rows += [(100 + i, i % 3, 100 + i, 99 + i if i else None, "long") for i in range(40)]
        kept, counts = docs.package_comments(spark.createDataFrame(rows, DOCS))
        want, want_counts = brute_package(rows)
        assert {x.symbol: (x.origin, x.comment) for x in kept.collect()} == want
        assert counts == want_counts
        assert counts["pruned"] >= 20
    kept, counts = docs.package_comments(spark.createDataFrame([], DOCS))
    assert kept.count() == 0 and counts == {"pruned": 0, "shortened": 0, "dropped": 0}


def test_long_chain_and_cycle(spark):
    rows = [(0, None, "text")] + [(i, i - 1, None) for i in range(1, 300)] + [(500, 501, None), (501, 500, None), (502, 501, None), (600, 601, None)]
    got = {r.symbol: (r.target, r.hops, r.state) for r in docs.doc_inheritance(spark.createDataFrame(rows, "symbol bigint, origin bigint, comment string")).collect()}
    assert got[299] == (0, 299, "found") and got[600] == (None, 1, "dropped")
    assert got[500] == got[502] == (None, None, "cycle")


def test_templates_at_their_pins(spark):
    r = random.Random(7)
    n = 40
    homes = {i: i % 3 for i in range(n)}
    history = []
    for i in range(n):
        lo = 0
        while lo < 6:
            hi = lo + r.randint(0, 3)
            if r.random() < 0.85:
                bare = r.random() < 0.7
                history.append((i, lo, hi, r.choice([None, r.randrange(n), 77]), None if bare else f"{i}@{lo}"))
            lo = hi + 1
    history = [h for h in history if h[0] > 1] + [(i, 0, 9, 1 - i, None) for i in (0, 1)]
    pins = [(p, v, d, r.randint(0, 5)) for p in range(3) for v in range(3) for d in range(3)]
    pages = [(homes[i], v, i) for i in range(n) for v in range(3)]
    pinned = {(p, v, d): at for p, v, d, at in pins}

    def walk(p, v, symbol):
        at, hops, seen = symbol, 0, set()
        while True:
            if at in seen:
                return (None, None, None)
            seen.add(at)
            frame = next((h for h in history if h[0] == at and h[1] <= pinned.get((p, v, homes.get(at)), -1) <= h[2]), None)
            if frame is None or frame[4] is not None or frame[3] is None:
                return (at, hops, (frame[4] if frame else None) or "")
            at, hops = frame[3], hops + 1

    frame = spark.createDataFrame
    got = docs.expand_templates(frame(pages, "package int, ver int, symbol bigint"), frame(history, "symbol bigint, lo int, hi int, origin bigint, comment string"), frame(pins, "package int, ver int, dep int, dep_ver int"), frame(list(homes.items()), "symbol bigint, package int"))
    found = {(x.package, x.ver, x.symbol): (x.target, x.hops, x.comment) for x in got.collect()}
    want = {page: walk(*page) for page in pages}
    assert found == want
    assert any(w[0] is None for w in want.values()) and max(w[1] or 0 for w in want.values()) > 1
