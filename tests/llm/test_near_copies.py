"""The pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline as cp
from tests.llm.test_operators import roots
from vellum.llm import near_copies, simhash


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return roots(len(texts), links)


def edited_texts():
    """Chains and stars of edited texts, about the threshold, and some that are alike but not near."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = ["", None, "  ", "x", "X", "one two three"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(12):
            w = list(base) if rng.random() < 0.7 else texts[-1].split()
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    return texts


def test_near_copies_against_brute_force(docs_of):
    texts = edited_texts()
    want = brute_groups(texts)
    for chunk in (near_copies.CHUNK, 3):
        got = {r.doc_id: r.root for r in near_copies.near_copies(docs_of(list(enumerate(texts))), chunk=chunk).collect()}
        assert len(got) == len(texts) and len({(got[i], want[i]) for i in got}) == len(set(want)) == len(set(got.values()))


def test_trie_join_links_near_fingerprints(docs_of):
    texts = edited_texts()
    marked = [(r.node, r.fp) for r in near_copies.marked_rows(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()]
    fps = [fp % (1 << 64) for _, fp in marked]
    assert fps == [simhash.fingerprint(t, near_copies.SHINGLE) for t in texts]
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.MAX_BITS or marked[i][0] == marked[j][0]])
    spark = docs_of([]).sparkSession
    links = near_copies.fingerprint_links(spark.createDataFrame(sorted(set(marked)), "node bigint, fp bigint")).collect()
    first = {node: i for i, (node, _) in reversed(list(enumerate(marked)))}
    got = roots(len(fps), [*((first[r.u], first[r.v]) for r in links), *((i, first[n]) for i, (n, _) in enumerate(marked))])
    assert got == want and len(set(got)) < len(set(n for n, _ in marked))


def test_trie_join_alone_brings_the_closest(spark, docs_of):
    """Without the bands, pairs within the budget of bits are still found."""
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join(words[:1000] + ["x"] + words[1001:]), " ".join(words[::-1])]
    marked = near_copies.marked_rows(docs_of(list(enumerate(texts)))).collect()
    alone = spark.createDataFrame([(*r[:4], [hash((r.doc_id, k)) for k in range(3)], bytes(r.hashes)) for r in marked], "doc_id bigint, text_hash bigint, node bigint, fp bigint, bands array<bigint>, hashes binary")
    found = near_copies.node_roots(near_copies.stored(alone)).collect()
    node = {r.doc_id: r.node for r in marked}
    assert {r.node for r in found} == {node[0], node[1]} and len({r.root for r in found}) == 1


def test_stage_keeps_one_of_each_group(spark, docs_of):
    texts = edited_texts()
    kept = cp.drop_near_duplicates(spark, docs_of(list(enumerate(texts))), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_groups(texts)))


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = brute_groups([r.text for r in rows])
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {rows[i].doc_id for i in set(want)}


def test_stage_with_null_and_repeated_ids(spark, docs_of):
    rows = [(None, "alone one"), (None, "alone two"), (None, "copied text"), (4, "copied text"), (5, "a text"), (5, "another text"), (5, "a text"), (6, "another text"), (None, None), (7, "")]
    kept = [(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs_of(rows), "").collect()]
    assert sorted(kept, key=str) == sorted([(None, "alone one"), (None, "alone two"), (4, "copied text"), (5, "a text"), (5, "another text"), (7, "")], key=str)
