import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.leakage import SCALES, ItemIndex, _scan, find_leaks, item_passages, leak_words, simhashes

RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(4000)]


def passage(n=70):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


ITEMS = [(i, f"Read this.\n{passage()}\nDo not explain.") for i in range(40)]


def frames(spark, docs, items=ITEMS):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def run(spark, docs, items=ITEMS, **kw):
    return sorted((r["doc_id"], r["item_id"]) for r in find_leaks(*frames(spark, docs, items), "doc_id", "item_id", **kw).collect())


def body(i):
    return ITEMS[i][1].split("\n")[1].split()


def test_whole_part_edited_and_wrapped(spark):
    edited = body(2)[10:50]
    edited[8], edited[20] = "other", "new words"
    del edited[30]
    docs = [
        (0, passage(300)),
        (1, passage(50) + " " + " ".join(body(1)) + " " + passage(20)),
        (2, passage(50) + " " + " ".join(edited)),
        (3, "<p>" + "</p><p>".join(" ".join(body(3)[k : k + 9]).upper() for k in range(0, 45, 9)) + "</p>"),
        (4, "x " + "\\n".join(body(4)[:25])),
        (5, passage(30) + " " + " ".join(body(5)[:9]) + " " + passage(30)),
        (6, "Read this. " + passage(40) + " Do not explain."),
        (7, None),
        (8, ""),
        (9, " ".join(body(6)[:30] + body(7)[:30])),
        (1, " ".join(body(1)[:30])),
    ]
    want = [(1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (9, 6), (9, 7)]
    assert run(spark, docs) == want
    assert run(spark, docs, slice_items=7) == want


def test_same_template_with_other_names_is_no_leak(spark):
    line = "when {} sells the {} ledger, {} keeps {} pages about the glacier of {}"
    item = ". ".join(line.format(*(RNG.choice(VOCAB) for _ in range(5))) for _ in range(5))
    other = ". ".join(line.format(*(RNG.choice(VOCAB) for _ in range(5))) for _ in range(5))
    items = [*ITEMS, (99, f"Read this.\n{item}\nDo not explain.")]
    assert run(spark, [(1, other), (2, item)], items) == [(2, 99)]


def test_no_item_is_left_empty(spark):
    one, ends = passage(), passage(30)
    items = [*ITEMS, *((100 + i, one) for i in range(4)), *((200 + i, f"Read {i}.\n{one}") for i in range(3)), *((300 + i, f"Read this.\n{ends}\n{passage()}\nDo not explain.") for i in range(3))]
    assert run(spark, [(1, one), (2, ends)], items) == [*((1, 100 + i) for i in range(4)), *((1, 200 + i) for i in range(3)), *((2, 300 + i) for i in range(3))]
    got = {r["item_key"]: r["passage"] for r in item_passages(frames(spark, [(0, "")], items)[1], "item_id", "text").collect()}
    assert got[0] == ITEMS[0][1].split("\n")[1] and got[100] == one and got[200] == f"Read 0.\n{one}"


def test_triples_are_weighed_over_all_slices(spark):
    common, own = passage(16).split(), [passage(11).split() for _ in range(24)]
    items = [(i, f"Read this.\n{' '.join(common + own[i])}\nDo not explain.") for i in range(24)]
    docs = [(1, " ".join(common + ["other"] + own[3][1:]))]

    def shares(**kw):
        return {r["item_id"]: r["weight_share"] for r in find_leaks(*frames(spark, docs, items), "doc_id", "item_id", weight_share=0, **kw).collect()}

    whole = shares()
    assert whole[3] < 0.9 and shares(slice_items=5) == whole


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, passage())], []) == []


def test_words():
    assert leak_words("<b>Café&nbsp;au</b> lait\\n\\u0041b 29.87") == ["café", "au", "lait", "ab", "29", "87"]
    assert leak_words(None) == leak_words("") == []


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 12), st.sampled_from(SCALES))
def test_blocks_find_every_pair_within_the_radius(seed, flips, scale):
    rng = np.random.default_rng(seed)
    index = ItemIndex([(0, [f"a{k}" for k in range(50)])], (scale,)).scales[0]
    probes = index.prints.copy()
    for _ in range(flips):
        probes ^= np.uint64(1) << rng.integers(0, 64, len(probes)).astype(np.uint64)
    i, j = index.near(probes)
    found = set(zip(i.tolist(), j.tolist()))
    assert len(found) == len(i)
    assert found == {(a, b) for a in range(len(probes)) for b in range(len(probes)) if bin(int(probes[a]) ^ int(index.prints[b])).count("1") <= scale.radius}


def test_recall_by_edited_words():
    """Of 20 and 40 word pieces with up to two words in 20 replaced, at least 0.9 are found, and item-sized windows alone find as many."""
    rng = random.Random(3)
    items = [(i, body(i)) for i in range(len(ITEMS))]
    both, large = ItemIndex(items), ItemIndex(items, SCALES[:1])
    for edits in (0, 1, 2):
        for size in (20, 40):
            docs = []
            for n in range(200):
                k, words = rng.choice(items)
                at = rng.randrange(len(words) - size + 1)
                piece = words[at : at + size]
                for x in rng.sample(range(size), edits * size // 20):
                    piece[x] = f"new{rng.randrange(10**6)}"
                docs.append(((n, k), [f"f{rng.randrange(10**6)}" for _ in range(40)] + piece + [f"f{rng.randrange(10**6)}" for _ in range(40)]))
            for index in (both, large):
                found = {(doc[0], item) for doc, item, *_ in _scan(index, docs, 15, 0.5)}
                assert found <= {key for key, _ in docs} and len(found) >= 0.9 * len(docs), (edits, size, len(found))


def test_similar_windows_have_near_prints():
    words = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = simhashes(words, 20), simhashes(np.concatenate([words[:39], words[:1]]), 20)
    assert (a[:-1] == b[:-1]).all() and np.bitwise_count(a[-1:] ^ b[-1:])[0] < 24
    assert len(simhashes(words[:5], 6)) == 0
