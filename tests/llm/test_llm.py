import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import clusters, cooccurrence, encoding, graph_index, mixing, terms, tokens, vectors


# terms


def test_containers():
    for n in (0, 1, 5, 2047, 2048, 9000, 32768):
        p = np.array(sorted(random.Random(n).sample(range(32768), n)), np.uint16)
        c = terms.pack(p)
        assert (terms.unpack(c) == p).all() and (len(c) == 4096) == (n >= 2048)


def test_term_frequencies(spark):
    rnd = random.Random(1)
    lists = [[f"t{int(rnd.paretovariate(0.7)) % 200}" for _ in range(rnd.randrange(0, 30))] for _ in range(5000)] + [None, [], [None, "t1"], ["all"]]
    df = spark.createDataFrame([(x, 1) for x in lists], "labels array<string>, term int").repartition(3)
    got = {r["term"]: (r["n_occurrences"], r["n_records"], r["mark"]) for r in terms.term_frequencies(df, "labels").collect()}
    occ = Counter(t for x in lists if x for t in x if t)
    docs = Counter(t for x in lists if x for t in {t for t in x if t})
    n = sum(1 for x in lists if x and any(x))
    assert got == {t: (occ[t], docs[t], "rare" if occ[t] < 5 else "common" if docs[t] > n / 4 else None) for t in occ}
    assert terms.term_frequencies(df.limit(0), "labels").count() == 0


def test_union_of_bitmaps(spark):
    rows = [("a", 0, terms.pack(np.array([1, 2], np.uint16)), 3), ("a", 0, terms.pack(np.arange(2, 3000, dtype=np.uint16)), 4)]
    out = terms.union_bitmaps(spark.createDataFrame(rows, "term string, chunk long, bitmap binary, n_occurrences long"))
    assert out.select(terms.cardinality(F.col("bitmap")).alias("c"), "n_occurrences").first() == (2999, 7)


def test_latest_walks(spark):
    rows = [(1, ["a"], 1, 1), (1, ["b.x "], 2, 1), (1, ["b.x "], 2, 1), (2, [None, " \t", ".x"], None, 1), (None, ["c"], 1, 1), (None, ["c"], 1, 1)]
    df = spark.createDataFrame(rows, "walk_id long, tokens array<string>, loaded_at int, walked_at int")
    assert sorted((r["walk_id"] or 0, r["labels"]) for r in terms.walk_labels(df).collect()) == [(0, ["c"]), (1, ["b"]), (2, [])]


# co-occurrence


def tail_exact(count, p, times):
    pmf = np.array([1.0])
    for q, n in zip(p, times):
        for _ in range(int(n)):
            pmf = np.convolve(pmf, [1 - q, q])
    return math.log(pmf[int(count) :].sum())


def test_tails():
    p, times = np.array([[0.05, 0.2, 0.01]] * 5), np.array([40.0, 25.0, 100.0])
    for c in (3, 9, 12, 18, 30):
        got = cooccurrence.log_tail(np.full(5, c), p, times)[0]
        assert got == pytest.approx(tail_exact(c, p[0], times), abs=0.12)
    assert cooccurrence.log_tail(np.array([0]), p[:1], times)[0] == 0
    assert cooccurrence.log_tail(np.array([166]), p[:1], times)[0] == -np.inf


def test_null_keeps_margins():
    k, n_items = np.array([2, 5, 30]), np.array([10.0, 4.0, 1.0])
    d, n_baskets = np.array([1, 2, 4]), np.array([20.0, 15.0, 5.0])
    x, y = cooccurrence.fit_null(k, n_items, d, n_baskets)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * n_baskets).sum(1), k, rtol=1e-6) and np.allclose((p * n_items[:, None]).sum(0), d, rtol=1e-6)


def test_chances_between_the_classes():
    k, n_items = np.array([2.0, 5, 30]), np.array([10.0, 4.0, 1.0])
    d, n_baskets = np.array([1.0, 2, 4]), np.array([20.0, 15.0, 5.0])
    x, y = cooccurrence.fit_null(k, n_items, d, n_baskets)
    p = (cooccurrence.chances(np.array([2, 3, 5, 30]), k, x, y) * n_baskets).sum(1)
    assert np.allclose(p[[0, 2, 3]], k, rtol=1e-6) and p[1] == pytest.approx(3, rel=0.05)


def test_pairs(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "LONG", 3)
    monkeypatch.setattr(cooccurrence, "PAIRS_IN_MEMORY", 50)
    rnd = random.Random(3)
    rows = [(b, f"i{int(rnd.paretovariate(0.8)) % 40:02d}") for b in range(300) for _ in range(rnd.randrange(1, 9))] + [(None, "i01"), (5, None), (5, "i01"), (5, "i01")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "h long, it string, basket int")
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    freq = Counter(i for s in baskets.values() for i in s)
    want = Counter(p for s in baskets.values() for p in combinations(sorted(i for i in s if freq[i] >= 5), 2))
    c = cooccurrence.Cooccurrence(df, "h", "it", 5)
    found = c.discoveries().collect()
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in found} == dict(want)
    tests = math.comb(sum(v >= 5 for v in freq.values()), 2)
    ps = sorted((math.exp(r["log_p"]), r["item_a"], r["item_b"]) for r in found)
    q, low = {}, 1.0
    for rank in range(len(ps), 0, -1):
        low = min(low, ps[rank - 1][0] * tests / rank)
        q[ps[rank - 1][1:]] = low
    assert all(r["q_value"] == pytest.approx(q[r["item_a"], r["item_b"]], rel=1e-6) for r in found)
    assert cooccurrence.Cooccurrence(df.limit(0), "h", "it").counts().count() == 0


# vectors and clusters


def blobs(n_groups=60, size=12, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n_groups, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return np.vstack([g + rng.normal(size=(size, dim)) * 0.03 for g in c]), np.repeat(np.arange(n_groups), size)


def test_graph_recall():
    x, _ = blobs(150, 15)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = graph_index.Graph(x).search(x.astype(np.float32), 40)
    s = x @ x.T
    top = np.argsort(-s, axis=1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(ids, top)]) > 0.97


def frame(spark, x):
    return spark.createDataFrame([(f"w{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)], "label string, vector array<float>")


@pytest.mark.parametrize("most, pivots", [(16384, 4096), (200, 4096), (60, 8)])
def test_most_similar(spark, most, pivots):
    x, _ = blobs()
    got = vectors.most_similar(frame(spark, x), 3, shard_points=most, n_pivots=pivots).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(f"w{i:05d}", f"w{j:05d}") for i in range(len(u)) for j in np.argsort(-s[i])[:3]}
    assert len(want & {(r["label"], r["neighbour"]) for r in got}) / len(want) > 0.97
    assert Counter(r["label"] for r in got).most_common(1)[0][1] == 3


def test_similar_small_and_copies(spark):
    one = frame(spark, np.eye(3)[:1])
    assert vectors.most_similar(one, 5).count() == 0 and vectors.most_similar(one.limit(0), 5).count() == 0
    same = frame(spark, np.ones((9, 4)))
    assert vectors.most_similar(same, 2).where("cosine > 0.999999").count() == 18
    pairs = vectors.similar_pairs(vectors.most_similar(same, 8), 0.9)
    assert pairs.count() == 36


def test_copies_beyond_a_shard(spark):
    x = np.vstack([np.tile(np.eye(8)[:1], (150, 1)), blobs(20, 5, 8)[0]])
    got = vectors.most_similar(frame(spark, x), 4, shard_points=40, n_pivots=8).collect()
    per = Counter(r["label"] for r in got)
    assert len(per) == len(x) and set(per.values()) == {4}
    assert all(r["cosine"] > 0.999999 for r in got if r["label"] < "w00150")
    assert all(r["label"] != r["neighbour"] for r in got)
    r = vectors.Router(frame(spark, x), "label", most=40, n_pivots=8)
    home = r.place(frame(spark, x), "label", 1).toPandas()
    assert len(home) == len(x) and not home["visitor"].any() and home["shard"].value_counts().max() <= 75


def test_neighbours_among_copies(spark):
    near = np.tile([0.9, 0.436, 0, 0, 0, 0, 0, 0], (6, 1)) + np.eye(8)[[2, 3, 4, 5, 6, 7]] * 0.02
    x = np.vstack([np.tile(np.eye(8)[:1], (400, 1)), near])[np.random.default_rng(3).permutation(406)]
    got = {}
    for r in vectors.most_similar(frame(spark, x), 4, shard_points=40, n_pivots=8).orderBy("label", "rank").collect():
        got.setdefault(r["label"], []).append(r["neighbour"])
    copies = [f"w{i:05d}" for i in np.flatnonzero(x[:, 0] == 1)]
    others = {f"w{i:05d}" for i in np.flatnonzero(x[:, 0] < 1)}
    assert all(got[c] == [y for y in copies[:5] if y != c][:4] for c in copies)
    assert all(set(got[o]) <= others - {o} and len(got[o]) == 4 for o in others)  # not copies, which are farther


def test_parts_by_hash_are_all_asked():
    cell = vectors.Cell(np.zeros((0, 8), np.float32), np.zeros(0, int), np.zeros(0), 5)
    counts, s = cell.by_hash(np.array([7, 4]), 5)
    assert counts.tolist() == [5, 5] and s.tolist() == [2, 3, 4, 0, 1, 4, 0, 1, 2, 3]


def test_latest_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0], 1), ("a", [0.0, 2.0], 2), ("a", [0.0, 2.0], 2), ("b", None, 1), ("c", [1.0], 1), ("d", [0.0, 0.0], 1), ("e", [nan, 1.0], 1), ("f", [inf, 1.0], 1), (None, [1.0, 1.0], 1), ("g", [1.0, 1.0], None), ("h", [1.0, None], 3)]
    got = vectors.latest_vectors(spark.createDataFrame(rows, "l string, v array<float>, label int"), "l", "v", "label", 2)
    assert {r["label"]: r["vector"] for r in got.collect()} == {"a": [0.0, 2.0], "g": [1.0, 1.0]}


def test_shards_cover_all_cells():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(50, 8))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    w = rng.integers(0, 50, 50)
    w[7] = 1000
    shard, n = vectors.plan_shards(p, w, 100)
    load = np.bincount(shard, weights=w, minlength=n)
    assert (shard >= 0).all() and n == shard.max() + 1
    assert load[shard[7]] == 1000 and (np.delete(load, shard[7]) <= 100).all()


@pytest.mark.parametrize("most, pivots", [(16384, 4096), (100, 4096), (50, 8)])
def test_clusters(spark, most, pivots):
    x, g = blobs(40, 9)
    members, groups = clusters.cluster(frame(spark, x).repartition(5), 0.8, shard_points=most, n_pivots=pivots)
    got = {r["label"]: r["cluster"] for r in members.collect()}
    assert all(got[f"w{i:05d}"] == f"w{g[i] * 9:05d}" for i in range(len(x)))
    rows = groups.collect()
    assert len(rows) == 40 and all(r["size"] == 9 and len(r["typical"]) == 3 for r in rows)
    assert clusters.groups_of(members, 10).count() == 0
    empty, none = clusters.cluster(frame(spark, x[:1]).limit(0), 0.8)
    assert empty.count() == 0 and none.count() == 0


def test_ward_order():
    s = np.array([[1.0, 0.0], [0.999, 0.04], [0.0, 1.0]])
    assert len(set(clusters.ward(np.ones(3), s, 0.9).tolist())) == 2
    assert len(set(clusters.ward(np.ones(3), s, -1.0).tolist())) == 1


def test_ward_equals_the_plain_agglomeration():
    rng = np.random.default_rng(5)
    for t in (0.3, 0.6, -2.0):
        x = rng.normal(size=(60, 6)) + np.repeat(rng.normal(size=(6, 6)) * 2, 10, 0)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sets = [[i] for i in range(60)]
        while True:
            best = (np.inf, 0, 0)
            for i in range(len(sets)):
                for j in range(i):
                    a, b = x[sets[i]].mean(0), x[sets[j]].mean(0)
                    if a @ b >= t:
                        n, m = len(sets[i]), len(sets[j])
                        best = min(best, (n * m / (n + m) * ((a - b) ** 2).sum(), i, j))
            if best[0] == np.inf:
                break
            sets[best[2]] += sets.pop(best[1])
        got = clusters.ward(np.ones(60), x, t)
        assert {frozenset(c) for c in sets} == {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got.tolist())}


# tokens


TEXTS = ["", None, " ", "  two  blanks ", "it's 12345 a\n\n b\t\tc ", "<|endoftext|> x", "x" * 900, "ab" * 600 + " é", "Žluťoučký kůň", "日本語" * 200, "a b\x85c\x1cd", "🏛️ ok", "﻿¿Qué?"]


def test_encoding_equals_the_public_encoder(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = tokens.read_ranks(tokens.vocabulary_path())
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice(" \n\t ab'sñ1  .,\x1c　é") for _ in range(15)) for _ in range(500)]
    want = [ref.encode_ordinary(t) if t else [] for t in texts]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, ["doc_id"], "text").collect()}
    assert [got[i] for i in range(len(texts))] == want
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, ["doc_id"], "text").collect()}
    assert [n[i] for i in range(len(texts))] == list(map(len, want))
    assert tokens.encode(df.limit(0), ["doc_id"], "text").count() == 0


def test_long_words_merge_alike():
    ranks = tokens.read_ranks(tokens.vocabulary_path())
    for w in (b"internationalization", "Überprüfungsausschuss".encode(), b"aaaaaaaabbbbbbbb", bytes(range(33, 120))):
        assert tokens.merge_short(w, ranks) == tokens.merge_long(w, ranks)


def test_whole_round_trip():
    ranks = tokens.read_ranks(tokens.vocabulary_path())
    back = {v: k for k, v in ranks.items()}
    e = tokens.Encoder(ranks, tokens.split_pattern())
    for t in TEXTS:
        assert b"".join(back[i] for i in e.encode(t)).decode() == (t or "")


# mixing


def test_solve():
    p = mixing.solve({"a": 100, "b": 1000, "c": 0}, {"a": 3, "b": 1, "c": 5}, {"a": 1.0, "b": 3.0, "c": 1.0})
    assert p.exponent == 0 and p.tokens == {"a": 300, "b": 900}
    p = mixing.solve({"a": 100, "b": 1000}, {"a": 3, "b": 2}, {"a": 1.0, "b": 1.0}, budget=1200)
    assert p.tokens["a"] <= 300 and 0 < p.exponent < 1 and sum(p.tokens.values()) == pytest.approx(1200, abs=2)
    p = mixing.solve({"a": 100, "b": 1000}, {"a": 9, "b": 9}, target_entropy=0.5)
    assert mixing.entropy(p.shares) == pytest.approx(0.5, abs=1e-6)
    assert mixing.solve({}, {}, {}).tokens == {}


def test_mix(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join("word" for _ in range(rnd.randrange(1, 60))), rnd.choice([" A\t", "a", "b", "B ", "zz", None]), i) for i in range(3000)] + [(9000, None, "a", 0), (9001, "", "b", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, epoch long")
    t = spark.createDataFrame([("A", 3.0, 2), ("b", 1.0, 1), ("absent", 5.0, 1), (None, 1.0, 1)], "source string, target_weight double, max_repeats int")
    mixed, report = mixing.mix(d, t)
    rows = mixed.collect()
    share = Counter()
    for r in rows:
        share[r["source"]] += r["n_tokens"]
    total = sum(share.values())
    assert set(share) == {"a", "b"} and share["a"] / total == pytest.approx(0.75, abs=0.003)
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
    half = Counter()
    for r in rows:
        if r["mix_block"] < 500:
            half[r["source"]] += r["n_tokens"]
    assert half["a"] / sum(half.values()) == pytest.approx(0.75, abs=0.02)
    out = {r["source"]: r for r in report.collect()}
    assert set(out) == {"a", "b", "absent"} and out["absent"]["mixed_tokens"] == 0 and out["a"]["mixed_tokens"] == share["a"]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(d.repartition(7), t)[0].collect()))
    none, empty = mixing.mix(d, t.limit(0))
    assert none.count() == 0 and empty.count() == 0


def test_mix_for_a_budget_and_an_entropy(spark):
    from quarry.llm import queries

    out = {r["source"]: r for r in queries.p7_budget_shares(spark, "/root/testdata/sf0.001").collect()}
    live = {s: r for s, r in out.items() if r["source_tokens"] and r["target_share"]}
    x = next(iter(live.values()))["exponent"]
    raw = {s: r["target_share"] ** (1 - x) * r["natural_share"] ** x for s, r in live.items()}
    assert 0 < x < 1 and all(r["planned_share"] == pytest.approx(raw[s] / sum(raw.values()), rel=1e-9) for s, r in live.items())
    budget = sum(r["source_tokens"] for r in live.values())
    used = {s: r["planned_share"] * budget / r["source_tokens"] / r["max_repeats"] for s, r in live.items()}
    assert max(used.values()) == pytest.approx(1, abs=1e-6)  # the least exponent at which no source passes its limit
    assert all(r["most_uses"] <= r["max_repeats"] for r in out.values())
    uses = Counter((r["source"], r["doc_id"]) for r in queries.p7_budget_mix(spark, "/root/testdata/sf0.001").collect())
    assert all(n <= out[s]["max_repeats"] for (s, _), n in uses.items())
    shares = [r["planned_share"] for r in queries.p7_entropy_shares(spark, "/root/testdata/sf0.001").collect() if r["planned_share"] > 0]
    assert -sum(p * math.log(p) for p in shares) == pytest.approx(1.7, abs=1e-6)


# garbled text


CLEAN = [
    "Der Kläger trägt die Kosten; vgl. § 5 – „ohne Gewähr“ über 12 €.", "Attendu que l’appel est fondé; la réfection où Noël « déjà » vu.",
    "De ello no se sigue que el muelle; según la cláusula «en su estado» 1.º ¿Álabe?", "Não se vê que a condenação; nos termos da CONDENAÇÃO É ÂMBITO GÂ",
    "W ocenie sądu łąkę się że przez „źródło” Świtlak", "По мнению суда, дело не было рассмотрено против ООО «Щегеньев»",
    "the naïve reading of Druö and Tarné is “time at large” within § 7 · £12", "Ðórfell / Þverá / Åsgård / Œuvre", "├─ A 1 ┬ A 2\n└─ B 1 ┴ B 2", "√50 ≈ 4,4; ¬(a ∧ b)",
    "15 ½ m³ × 2 µm ± ¼ °C ¶", "‰ † ‡ ™ ƒ ˆ ˜", "⚖️ 🏛️", "M&uuml;ckst&auml;tt und &sect; 5 der und die", "Tarné is the of", "plain", "﻿",
]


FOREIGN = [
    "Soud rozhodl, že žaloba není důvodná a žalobce je povinen zaplatit náhradu nákladů řízení.", "Mahkeme davacının isteğini reddetti ve yargılama giderlerinin ödenmesine karar verdi.",
    "Το δικαστήριο απέρριψε την αγωγή και καταδίκασε τον ενάγοντα στα δικαστικά έξοδα.", "A bíróság a keresetet elutasította, és kötelezte a felperest a perköltség megfizetésére.",
    "Instanța a respins acțiunea și a obligat reclamantul la plata cheltuielilor de judecată.", "Tòa án đã bác đơn kiện và buộc nguyên đơn phải trả chi phí tố tụng. Nguyễn Văn Hùng.",
    "Суд відхилив позов і зобов’язав позивача сплатити судові витрати. Їжак, ґанок.", "Domstolen avslog talan och ålade käranden att betala rättegångskostnaderna för åtgärden.",
    "Teismas ieškinį atmetė ir priteisė bylinėjimosi išlaidas, žmogus, ūkis, ėjo.", "Суд је одбио тужбу и обавезао тужиоца да плати трошкове поступка. Љубав, њега.",
    "Dómurinn hafnaði kröfunni og dæmdi stefnanda til að greiða málskostnað.", "裁判所は請求を棄却した。", "법원은 청구를 기각하였다.", "رفضت المحكمة الدعوى", "בית המשפט דחה את התביעה",
    "The composer Dvořák met Recep Tayyip Erdoğan and Şahin in Łódź near Ελλάδα.", "We have ≥ and ≤ and α-β and ∑x² ≠ π, 5 µm, 3 × 4, ∞, € 5, →, ✓ ok.",
]


def test_utf8_read_in_another_set_is_restored_in_any_language():
    right = total = 0
    for text in FOREIGN[:-1]:
        for read in ("cp1252", "latin_1", "cp437", "mac_roman"):
            try:
                garbled = text.encode().decode(read)
            except UnicodeDecodeError:
                continue
            hit, fixed, _ = encoding.inspect(garbled)
            assert hit, garbled
            total += 1
            right += fixed == text
    assert total > 30 and right / total >= 0.95
    assert encoding.inspect("GrÃ¶ÃŸe")[1] == "Größe"


def test_long_tokens_take_linear_time():
    import time

    for n in (1000, 4000):
        for garbled in (("Größe" * n)[:n].encode().decode("latin-1"), ("Größe" * n)[:n].encode("cp437").decode("cp1252"), "".join(random.Random(n).choices("ÃŸ€ß¶a", k=n))):
            began = time.process_time()
            assert encoding.inspect("x " + garbled)[0]
            assert time.process_time() - began < 0.3 * n / 1000 + 0.3


@pytest.mark.parametrize("text", CLEAN + FOREIGN)
def test_clean_text_is_no_case(text):
    assert encoding.inspect(text) == (False, text, 0)


PAIRS = [("utf-8", "cp1252", [0, 1, 2, 3, 6]), ("utf-8", "latin-1", [0, 1, 2, 3, 4, 5]), ("utf-8", "cp437", [0, 1, 4, 6]), ("utf-8", "cp850", [0, 1]), ("utf-8", "mac_roman", [0, 1, 6]), ("utf-8", "cp1251", [5, 0]), ("cp1251", "latin-1", [5]), ("koi8-r", "cp1251", [5]), ("cp1251", "koi8-r", [5]), ("cp1252", "cp850", [0, 1]), ("cp1252", "cp437", [1]), ("cp1252", "mac_roman", [0, 1]), ("cp1250", "cp1252", [4])]


def test_garbled_text_is_found_and_restored():
    restored = total = 0
    for written, read, which in PAIRS:
        for i in which:
            raw = CLEAN[i].encode(written, "ignore")
            text = raw.decode("cp1252", "ignore") if read == "cp1252" else raw.decode(read, "ignore")
            hit, fixed, n = encoding.inspect(text)
            assert hit and n, (written, read, text)
            total += 1
            restored += fixed == raw.decode(written)
    assert restored / total > 0.6
    twice = CLEAN[0].encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.inspect(twice)[0]
    assert encoding.inspect("die M&Atilde;&frac14;hle und der")[1] == "die Mühle und der"


def test_short_or_cheap_garbled_tokens_are_found():
    for text, fixed in [("the sum of 12 ¬£ is", "the sum of 12 £ is"), ("le droit √† dans", "le droit à dans"), ("according to √† the", "according to à the"), ("el caso según los ¬ª del", "el caso según los » del"), ("le cas Â» dans les", "le cas » dans les")]:
        assert encoding.inspect(text) == (True, fixed, 1), text
    passage = "задолженность по договору"
    for written, read in [("koi8-r", "cp1251"), ("cp1251", "koi8-r")]:
        hit, fixed, n = encoding.inspect("в суд не " + passage.encode(written).decode(read))
        assert hit and n and "задолженность" in fixed, (written, read)
    for text in ["РЕШЕНИЕ ООО и АО на", "тем, чем мнению в", "l’état n’était pas dans", "in the 105.263 £ of", "the « É » is", "CAFÉ» dans les"]:
        assert encoding.inspect(text) == (False, text, 0), text


def test_find_garbled(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "fÃ¼r die", "x"), (4, "lost � here", "x"), (5, "ok " * 50_000 + "Ã¼ber", "x"), (3, "fÃ¼r die", "x")]
    got = encoding.find_garbled(spark.createDataFrame(rows, "doc_id long, text string, restored string"), "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in got) == [3, 3, 4, 5] and {r["restored"] for r in got if r["doc_id"] == 3} == {"für die"}
    assert next(r for r in got if r["doc_id"] == 5)["restored"].endswith("über")


def test_the_model_of_the_corpus_decides_where_letters_are_regular(spark):
    good = "w ocenie sądu strony się więc nie zgadzają, że będzie później"
    bad = "strony siê wiêc nie pojawiły"
    rows = [(i, good, "x") for i in range(400)] + [(1000, bad, "x"), (1001, FOREIGN[0], "x"), (1002, None, "x"), (1003, "", "x"), (1004, "siê wiêc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string").repartition(5)
    got = {r["doc_id"]: r["restored"] for r in encoding.find_garbled(df, "doc_id", "text").collect()}
    assert got == {1000: bad.replace("ê", "ę"), 1004: "się więc"}
    assert not encoding.inspect(bad)[0]  # nothing tells without the corpus
    assert encoding.find_garbled(df.limit(0), "doc_id", "text").count() == 0


def test_model_slots():
    text = "zażółć — jaźń, Ü!"
    place, slots = encoding.contexts(text)
    assert [text[i] for i in place] == [c for c in text if c > "\x7f"]
    alike = {i: encoding.contexts(f"{text[i - 1]}{text[i]}{text[i + 1]}") for i in place}
    for i, s in zip(place, slots):
        inner = alike[i]
        assert s == inner[1][list(inner[0]).index(1)]
    assert encoding.contexts("1ü.")[1][0] == encoding.contexts(" ü ")[1][0] != encoding.contexts("aü ")[1][0]
    assert len(encoding.contexts("plain")[0]) == 0
