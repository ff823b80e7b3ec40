"""Operators that gather from the whole table: fingerprints, shards, mixing, scores, near-duplicates, archives."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import samples

from pvflow.llm import archives, lm, mixing, sharding, simhash
from pvflow.llm.fingerprints import fingerprint_documents

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def test_edited_texts_and_fingerprints(docs, empty):
    df = samples.with_extras(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "range", "next", "sketch")
    given = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint_documents(df).collect()}
    assert len(got) == len(given)
    for (i, text), (_, following) in zip(given, given[1:] + given[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[10].fingerprint == got[40].fingerprint != got[41].fingerprint
    prints = {got[i].fingerprint for i in (43, 44, 45)}
    assert prints == {""} and got[44].near_next == 1.0 and got[44].near_edited == 1.0
    longer = [got[i] for i in range(20, 39)]
    assert min(r.near_edited for r in longer) > 0.3 and sum(r.near_edited > r.near_next + 0.2 for r in longer) == len(longer)
    assert fingerprint_documents(empty).collect() == []


def test_every_row_has_a_fingerprint(docs):
    rows = fingerprint_documents(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert fingerprint_documents(docs.where("doc_id = 5")).first().near_next == 1.0


def test_order_matters_to_order_minhash(llm):
    words = [f"w{i}" for i in range(400)]
    blocks = [words[i : i + 20] for i in range(0, 400, 20)]
    random.Random(1).shuffle(blocks)
    moved = [w for b in blocks for w in b]
    rows = [(3, " ".join(words), None, None, None), (2, " ".join(moved), None, None, None), (1, " ".join(words[:380]), None, None, None)]
    got = {r.doc_id: r for r in fingerprint_documents(samples.table(llm, rows)).collect()}
    # almost the same pairs of words, but in another order; a cut end keeps the order
    assert got[3].near_next < 0.8
    kept = fingerprint_documents(samples.table(llm, [rows[0], (2, rows[2][1], None, None, None)])).where("doc_id = 3").first()
    assert kept.near_next > got[3].near_next


def test_shards(docs, empty):
    rows = sharding.shard_documents(samples.with_extras(docs, "shard", "slot", "size", "pos")).collect()
    assert len(rows) == docs.count()
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert sharding.shard_documents(empty).collect() == []


def test_ring_walk_against_row_by_row(llm):
    """Rows join a queue in ring order; every node takes from its front while its shard has room."""
    df = llm.range(3000).selectExpr("id AS doc_id", "id % 7 AS text_crc32")
    shards, nodes = 5, 6
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(df, ["doc_id", "text_crc32"], shards, nodes).collect()}
    points = sharding.ring(llm, shards, nodes).orderBy("arc").collect()
    rows = df.selectExpr("doc_id", "xxhash64(doc_id, text_crc32) AS pos").selectExpr("*", f"pmod(xxhash64(pos), {sharding.SLICES}) AS slice").collect()
    home = {}
    for r in rows:
        arc = next((p.arc for p in points if p.pos >= r.pos), 0)
        home.setdefault(arc, []).append((r.slice, r.pos, r.doc_id))
    load, queue, want = Counter(), [], {}
    room = {s: 3000 // shards + (s < 3000 % shards) for s in range(shards)}
    for lap in range(2):
        for p in points:
            queue += sorted(home.get(p.arc, [])) if lap == 0 else []
            while queue and load[p.shard] < room[p.shard]:
                want[queue.pop(0)[2]] = (p.shard, load[p.shard])
                load[p.shard] += 1
    assert got == want
    stay = sum(got[i][0] == p.shard for p in points for _, _, i in home.get(p.arc, []))
    assert stay > 0.4 * 3000  # most rows keep their home


def test_targets():
    assert mixing.targets([]) == []
    assert mixing.targets([("a", 0), (None, 0)]) == [0.0, 0.0]
    sizes = [("b", 100), ("a", 1000), (None, 10), ("c", 400)]
    got = dict(zip([s[0] for s in sizes], mixing.targets(sizes)))
    total = 1.5 * 1510
    assert math.isclose(sum(got.values()), total) and got[None] <= 20 and got["b"] <= 200 and got["c"] <= 800
    assert got[None] == 20 and got["b"] == 200  # both stop at twice their size
    assert math.isclose(got["c"], 800) and math.isclose(got["a"], total - 1020)


def test_permutations():
    for n in (1, 2, 3, 10, 257, 1000):
        for seed in (0, 5):
            assert sorted(mixing.permuted(np.arange(n), n, seed).tolist()) == list(range(n))
    a, b = (mixing.permuted(np.arange(1000), 1000, s) for s in (1, 2))
    assert (a == b).sum() < 20 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.15


def test_mix(docs, empty):
    df = samples.with_extras(docs, "size", "target", "block", "sid")
    rows = mixing.mix(df).collect()
    assert len(rows) == docs.count()
    words = lambda t: len(samples.WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, words(r.text)) for r in docs.collect())
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    goals = dict(zip(sizes, mixing.targets(list(sizes.items()))))
    taken = Counter()
    for source_size, target, t in ((r.source_size, r.target, r.taken) for r in rows):
        taken[source_size, round(target, 6)] += t
    for s, goal in goals.items():
        assert abs(taken[sizes[s], round(goal, 6)] - goal) <= max(0.05 * goal, 2 * mixing.BLOCK)
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, mixing.mix(df.repartition(5)).collect())) == sorted(map(key, rows))
    assert mixing.mix(empty).collect() == []


def test_counts_are_multinomial():
    """Mean and variance of the slots of a source over many shards, and the covariance of two."""
    shares = np.array([0.5, 0.3, 0.2])
    n = np.array([mixing.drawn(s, 400, shares) for s in range(4000)])
    assert (n.sum(axis=1) == 400).all() and np.allclose(n.mean(axis=0), 400 * shares, rtol=0.01)
    assert np.allclose(n.var(axis=0), 400 * shares * (1 - shares), rtol=0.08)
    assert np.isclose(np.cov(n[:, 0], n[:, 1])[0, 1], -400 * 0.5 * 0.3, rtol=0.1)


def test_every_slot_is_drawn_again_until_it_is_filled(llm, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mixing, "SHARD_RUN", 4)
    most = [100, 20, 60, 0]
    rows = mixing.draw_counts(llm, np.array([80.0, 30.0, 40.0, 5.0]), most).collect()
    got = Counter()
    by_shard = Counter()
    for r in sorted(rows, key=lambda r: r.shard):
        assert r.first == got[r.sid]
        got[r.sid] += r.n
        by_shard[r.shard] += r.n
    assert sum(got.values()) == 155 and all(got[i] <= m for i, m in enumerate(most)) and got[1] == 20
    assert all(n == 16 for s, n in by_shard.items() if s < 9) and len(by_shard) == 10
    full = mixing.draw_counts(llm, np.array([500.0, 500.0]), [10, 12]).collect()
    assert sum(r.n for r in full) == 22
    assert mixing.draw_counts(llm, np.array([0.0]), [0]).collect() == []


def test_mixed_pieces_are_the_counted_words(docs, empty):
    rows = mixing.mixed_pieces(docs).collect()
    whole = Counter()
    for r in rows:
        assert r.n_chars == len(r.text)
        whole[r.doc_id] += len(samples.WORD.findall(r.text))
    counted = Counter()
    for r in mixing.mix(docs).collect():
        counted[r.doc_id] += r.taken
    assert +whole == +counted
    filled = Counter()
    for r in rows:
        filled[r.shard, r.slot, r.source] += len(samples.WORD.findall(r.text))
    assert max(filled.values()) == mixing.BLOCK
    assert mixing.mixed_pieces(empty).collect() == []


def tokens(text):
    return (text or "").encode().translate(LOWER).split() + [b" "]


def test_scores(docs, empty):
    df = samples.with_extras(docs, "row", "n", "h", "c")
    rows = lm.score_documents(df).collect()
    given = docs.collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter()
    for r in given:
        if not out(r.doc_id):
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in given:
        toks = tokens(r.text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in toks)
        want[r.doc_id, out(r.doc_id), len(toks), sum(t in counts for t in toks), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score <= 0 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm.score_documents(empty).collect() == []


def test_only_held_out_documents(docs):
    rows = lm.score_documents(docs.where("crc32(CAST(doc_id AS STRING)) % 7 = 2")).collect()
    assert rows and all((r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0) for r in rows)


def grams(text):
    toks = tokens(text)
    return [(tuple(toks[i - n + 1 : i + 1]), i) for i in range(len(toks)) for n in (1, 2, 3) if i - n + 1 >= 0]


def brute_scores(rows):
    """Plain backoff over all n-grams: from the root to the longest history that training has seen."""
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(g for i, text in rows if not out(i) for g, _ in grams(text))
    total, known = sum(n for g, n in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

    def p(history, w):
        if not history:
            return (c[(w,)] + 1) / (total + known + 1)
        n, lower = c[history], p(history[1:], w)
        if c[(*history, w)]:  # an arc
            return (c[(*history, w)] + lm.K * lower) / (n + lm.K)
        return lm.K / (n + lm.K) * lower  # the failure arc

    def score(text):
        toks = tokens(text)
        return sum(math.log10(p(tuple(toks[max(0, i - 2) : i]), w)) for i, w in enumerate(toks))

    return Counter((i, round(score(text), 6)) for i, text in rows)


def test_scores_equal_plain_backoff_at_any_size(llm, docs, monkeypatch):
    """All n-grams count, however rare, on a table and on one four times as large, in small chunks and buckets."""
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    more = given + [(None if i is None else i + 1000 * k, f"{t or ''} river {k}") for k in (1, 2, 3) for i, t in given]
    for rows, chunk, bucket in ((given, 1_500_000, 12_000_000), (given, 700, 3_000), (more, 5_000, 20_000)):
        monkeypatch.setattr(lm, "CHUNK", chunk)
        monkeypatch.setattr(lm, "BUCKET_BYTES", bucket)
        df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(5).cache()
        assert Counter((r.doc_id, round(r.score, 6)) for r in lm.score_documents(df).collect()) == brute_scores(rows)


def test_probabilities_of_a_state_add_up_to_one():
    """Over all words and the unknown one, after histories of every kind."""
    texts = [samples.prose(samples.EN, 60, i) for i in range(4)]
    hasher = lm.Hasher()
    train = lm.chunk_of([hasher(lm.tokens(t.encode())) for t in texts])
    model = [dict(zip(*map(np.ndarray.tolist, lm.counted(k, np.zeros(len(k), np.uint64))), strict=True)) for k in train.keys]
    total, known = sum(model[0].values()), len(model[0])
    words = sorted({w for t in texts for w in lm.tokens(t.encode())})
    first = lm.tokens(texts[0].encode())
    for history in ([], first[3:4], first[4:6], [b"never"], [b"never", first[0]], [first[2], first[9]]):
        ends = words + [b"unknown"]
        chunk = lm.chunk_of([hasher([*history, w]) for w in ends])
        keys = [np.unique(k) for k in chunk.keys]
        counts = [np.array([m.get(x, 0) for x in k.tolist()], np.uint64) for m, k in zip(model, keys, strict=True)]
        _, _, whole = lm.traverse(chunk, counts, total, known)
        if history:
            before = lm.chunk_of([hasher(history)] * len(ends))
            keys = [np.unique(k) for k in before.keys]
            counts = [np.array([m.get(x, 0) for x in k.tolist()], np.uint64) for m, k in zip(model, keys, strict=True)]
            whole = whole - lm.traverse(before, counts, total, known)[2]
        assert math.isclose(sum(10**x for x in whole), 1.0, rel_tol=1e-9), history


def test_keys_survive_their_written_form():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64) << np.uint64(1))
    assert (lm._read(lm._written(keys)) == keys).all()
    out = rng.integers(0, 2, 5000, dtype=np.uint64)
    some = rng.choice(keys[:50], 5000)
    got_keys, got = lm.counted(some, out)
    want = Counter(some[out == 0].tolist())
    assert got_keys.tolist() == sorted(set(some.tolist())) and got.tolist() == [want[k] for k in got_keys.tolist()]


def plain_components(rows):
    prints = []
    for _, text in rows:
        words = (text or "").encode().translate(LOWER).split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        import xxhash

        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes)))
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i], changed = label[j], True
    ids = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            ids[g] = min(i, ids.get(g, i))
    return Counter((i, p, ids.get(g)) for (i, _), p, g in zip(rows, prints, label))


def test_near_duplicates(docs, empty):
    df = samples.with_extras(docs, "fp", "root", "node", "first")
    got = simhash.near_duplicates(df).collect()
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.keep_first(docs).collect()
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter({c: 1 for _, _, c in want if c is not None})
    assert sum(r.doc_id is None for r in kept) == 2


def test_links_of_dense_groups(llm):
    """Chains and crowded balls, with tiles far smaller than a shard."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)}
    chain = rng.getrandbits(64)
    for step in range(30):
        prints.add(chain)
        chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    for _ in range(400):
        near = 0x0F0F0F0F0F0F0F0F
        for b in rng.sample(range(64), rng.randrange(5)):
            near ^= 1 << b
        prints.add(near)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = llm.createDataFrame(signed, "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, tile=64)).collect()}
    fps = np.array(prints, np.uint64)
    parent = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    simhash._join(parent, *np.nonzero(near))
    groups = {}
    for (fp,), g in zip(signed, parent.tolist()):
        groups.setdefault(g, set()).add(fp)
    for members in groups.values():
        assert {roots.get(m, m) for m in members} == {min(members)}


PAGES = "page_id bigint, url string, html string"


def pages():
    body = "<html>" + "é text " * 30 + "</html>"
    rows = [(i, f"http://a.example/{i} x?q=ü&z", f"<p>{i}</p>" * (i + 1)) for i in range(12)]
    rows += [(20, "http://b", body), (14, "http://c", body), (31, None, body), (14, "http://c", body), (None, "http://d", body)]
    rows += [(40, "", "short"), (41, "http://e", "short"), (42, "http://f\nx", ""), (43, "http://g", None), (None, None, None)]
    return rows + [(50, "http://h", "\r\n\r\nWARC/1.1\r\n\n" * 20), (51, "http://i", "z" * 3_000_000)]


def test_archives(llm):
    df = samples.with_extras(llm.createDataFrame(pages(), PAGES).repartition(3), "path", "offset", "content", "digest")
    got = archives.archive_pages(df).collect()
    least = {}
    for i, _, html in pages():
        data = (html or "").encode()
        if i is not None:
            least[data] = min(i, least.get(data, i))
    want = Counter()
    for i, _, html in pages():
        data = (html or "").encode()
        first = least.get(data)
        again = len(data) >= 100 and first is not None and first != i
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    ids = {r.record_id for r in got if r.page_id is not None}
    assert len(ids) == len({r.page_id for r in got if r.page_id is not None})
    assert archives.archive_pages(llm.createDataFrame([], PAGES)).collect() == []


def test_arc_versions():
    for version in (1, 2):
        data = archives.arc_start(version, "x.arc")
        data += archives.arc_record(version, "http://a b/ü", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\n\nwith\nlines")
        data += archives.arc_record(version, None, b"", "2003")
        head, first, second = archives.read_arc(data)
        assert head.version == version and head.fields["url"].startswith("filedesc:")
        assert first.split().payload == b"body\n\nwith\nlines" and first.http_header(b"x") == b"y"
        assert " " not in first.fields["url"] and second.block == b""
        record = archives.to_warc(second.split())
        back = next(archives.read_warc(record + b"\r\n\r\n"))
        assert back.fields["warc-type"] == "resource" and back.fields["warc-date"] == "2003-01-01T00:00:00Z"
    odd = b"filedesc://y 0 20000101000000 text/plain 78\n1 0 o\nURL IP-address Archive-date Content-type Archive-length\n" + b" " * 15
    odd += b"\nhttp://q 1.2.3.4 20000102030405 text/html; charset=x 3\nabc\n"
    records = list(archives.read_arc(odd.replace(b" 78\n", b" %d\n" % (len(b"1 0 o\n") + 61 + 15))))
    assert records[-1].block == b"abc" and records[-1].fields["content-type"] == "text/html; charset=x"
