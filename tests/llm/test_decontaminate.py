import random
import re

from quillcount.llm import decontaminate as dc

DATA = "/root/testdata/sf0.001"


def normal(t):
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode())
    return re.sub(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", b" ", b)


def inside(pattern, text):
    """Semi-global edit distance, one row of the table after the other."""
    import numpy as np

    low = np.zeros(len(text) + 1, np.int64)
    t = np.frombuffer(text, np.uint8)
    place = np.arange(len(text) + 1)
    for i, c in enumerate(pattern):
        new = np.empty_like(low)
        new[0] = i + 1
        new[1:] = np.minimum(low[1:] + 1, low[:-1] + (t != c))
        low = np.minimum.accumulate(new - place) + place
    return int(low.min())


def brute(docs, items):
    out = {}
    for k, i in items:
        form = normal(i).strip()
        for d, t in docs:
            text = b" " + normal(t).strip() + b" "
            if form and len(form) >= dc.LEAST and len(text) > 0.9 * len(form):
                n = 0 if form in text else inside(form, text)
                if n <= int(dc.EDITS * len(form)):
                    out[d, k] = n
            elif form and b" " + form + b" " in text:
                out[d, k] = 0
    return out


def of(df):
    return {(r.doc_id, r.item_id): r.distance for r in df.collect()}


def test_edit_distance():
    rnd = random.Random(2)
    for _ in range(200):
        a = bytes(rnd.choices(b"abc ", k=rnd.randrange(1, 90)))
        b = bytes(rnd.choices(b"abc ", k=rnd.randrange(0, 120)))
        assert dc.edits_inside(a, b) == inside(a, b)


def test_table(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and of(dc.contaminated(docs, items)) == want
    assert of(dc.contaminated(docs, items, block_bytes=4000)) == want
    clean = {r.doc_id for r in dc.drop_contaminated(docs, items, block_bytes=5000).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_recall_of_edited_passages(spark):
    """Items with edits up to the limit, in blocks, are found as brute force finds them; at least 9 of 10."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("etaoinsh", k=rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(8, 70)))) for i in range(60)] + [(60, "short item"), (61, None), (62, "")]
    docs = []
    for d in range(300):
        text = items[rnd.randrange(60)][1]
        chars = list(text)
        for _ in range(rnd.randrange(0, int(dc.EDITS * len(text)) + 2)):
            at = rnd.randrange(len(chars))
            chars[at : at + 1] = rnd.choice(([], [rnd.choice("etaoinsh")], [chars[at], rnd.choice("etaoinsh")]))
        around = [" ".join(word() for _ in range(rnd.randrange(0, 80))) for _ in range(2)]
        docs.append((d, f"{around[0]}. {''.join(chars)}; {around[1]}"))
    docs += [(300, "A Short, item!"), (301, "ashort item"), (302, None)]
    want = brute(docs, [(k, t) for k, t in items if t])
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = of(dc.contaminated(*frames))
    assert got.items() <= want.items()
    assert len(got) >= 0.97 * len(want) and (300, 60) in got and (301, 60) not in got


def test_recall_and_distances_at_the_limit():
    """Passages with as many edits as are allowed: exact distances, and nine in ten or more in every class of length."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(7, 90)))) for i in range(60)]
    want, got = {}, {}
    for d in range(240):
        key, text = items[d % 60]
        chars = list(text)
        for _ in range(int(dc.EDITS * len(text))):
            at = rnd.randrange(len(chars))
            chars[at : at + 1] = rnd.choice(([], [rnd.choice("etaoinsh")], [chars[at], rnd.choice("etaoinsh")]))
        whole = f"{' '.join(word() for _ in range(40))}. {''.join(chars)}; {' '.join(word() for _ in range(40))}"
        least = inside(normal(text).strip(), normal(whole))
        if least <= int(dc.EDITS * len(normal(text).strip())):
            want[d, key] = least
        got |= found([(key, text)], [(d, whole)])
    assert got.items() <= want.items()
    lengths = dict(items)
    for low, high in ((0, 128), (128, 256), (256, 1000)):
        due = {x for x in want if low <= len(lengths[x[1]]) < high}
        assert len(due) > 10 and len(due & {*got}) >= 0.9 * len(due)


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (4, "ab ab ab ab ab ab ab ab ab ab ab ab ab"), (None, "日本語 テキスト")], "item_id long, text string")
    got = {*of(dc.contaminated(edge_docs, items))}
    assert got == {(7, 3), (8, 3), (11, 4), (12, None)}
    assert dc.contaminated(no_docs, items).collect() == [] and dc.contaminated(edge_docs, items.limit(0)).collect() == []
    assert dc.drop_contaminated(edge_docs, items).count() == edge_docs.count() - 4


def found(items, texts):
    """What an index of ``items`` finds in each of ``texts``, read alone."""
    import numpy as np

    index, out = dc.Index(items), {}
    for d, text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        out |= {(d, k): n for _, k, n in index.found(*dc.normalised(raw, np.array([0, len(raw)])))}
    return out


def test_exact_copies_at_every_offset():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 9)))
    items, texts = [], []
    for size in (32, 33, 40, 48, 60, 63, 64, 81, 90, 100, 127, 128, 150, 187, 190):
        text = " ".join(word() for _ in range(size))[:size].rstrip().ljust(size, "e")
        items.append((size, text))
        texts += [((size, offset), "a" * (offset + 8) + f" {text} " + " ".join(word() for _ in range(40))) for offset in range(16)]
    want = brute(texts, items)
    assert len(want) >= len(texts) and found(items, texts) == want


def test_text_without_spaces():
    """Items inside Chinese and Thai text and right after other text, exact and edited."""
    rnd = random.Random(9)
    scripts = [[chr(c) for c in range(0x4E00, 0x4F00)] + ["。", ",", "、"], [chr(c) for c in range(0x0E01, 0x0E2F)]]
    some = lambda letters, n: "".join(rnd.choices(letters, k=n))
    items = [(i, some(scripts[i % 2], rnd.randrange(11, 120))) for i in range(60)]
    texts = [(i, some(scripts[i % 2], rnd.randrange(1, 90)) + t + some(scripts[i % 2], 40)) for i, t in items]
    want = brute(texts, items)
    assert len(want) == 60 and found(items, texts) == want

    edited = []
    for i, t in items:
        chars = list(t)
        for _ in range(int(dc.EDITS * len(t.encode())) // 3):
            chars[rnd.randrange(len(chars))] = rnd.choice(scripts[i % 2])
        edited.append((i, some(scripts[i % 2], 50) + "".join(chars) + some(scripts[i % 2], 50)))
    want, got = brute(edited, items), found(items, edited)
    assert got.items() <= want.items() and len(want) > 50 and len(got) >= 0.95 * len(want)

    words = [(size, " ".join(some("etaoinsh", rnd.randrange(2, 9)) for _ in range(size))[:size].rstrip().ljust(size, "e")) for size in (32, 33, 34, 65, 66, 129, 130, 200)]
    glued = [(size, f"before it{t}after it") for size, t in words]
    assert found(words, glued) == {(size, size): 0 for size, _ in words}


def test_short_items_between_words():
    items = [(1, "東京タワー"), (2, "short item"), (3, "ภาษาไทย"), (4, "café")]
    texts = ["昨日は東京タワーに行った。", "a “short item”—here", "ashort item", "short itemé", "เรียนภาษาไทยทุกวัน", "cafés", "le café", "東京short item塔"]
    assert {*found(items, list(enumerate(texts)))} == {(0, 1), (1, 2), (4, 3), (6, 4), (7, 2)}
