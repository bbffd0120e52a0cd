"""Each operator against its brute-force version, on random texts, edge cases and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, lm_score, near_dedup, neighbours, pieces, pii, quality, secrets, shared, suffix_dedup, url_filter
from quern.llm.elias_fano import EliasFano, encode

RNG = random.Random(17)
WORDS = [f"{a}{b}" for a in "ka ti so mer lun dra vo pel".split() for b in "na ri tok es ul am".split()]


def text(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """documents with an extra column whose name operators use inside."""
    return spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, key long")


EDGES = [(100000, None), (100001, ""), (100002, " \n\t "), (100003, "one"), (100004, "One"), (100005, "é" * 300), (100006, "x " * 5000)]


def test_near_duplicates_match_all_pairs(spark):
    rows = []
    for _ in range(40):
        base = text(60).split()
        for _copy in range(RNG.randint(1, 5)):
            own = list(base)
            for _edit in range(RNG.randint(0, 4)):
                own[RNG.randrange(len(own))] = RNG.choice(WORDS)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, rows[0][1].upper()) for i in range(5)] + EDGES
    want = near_dedup.brute_force(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want
    assert len({c for _, c, _ in want.values()}) < len(want)


def test_near_duplicates_with_blocks_and_chains(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    base, rows = text(120).split(), []
    for i in range(60):  # a chain: neighbours are linked, ends are not
        base[(7 * i) % 120] = f"new{i}"
        rows.append((i, " ".join(base)))
    want = near_dedup.brute_force(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def templated(n: int) -> list[tuple[int, str]]:
    """Texts of one template whose slots have three variants each, and a copy of one that differs in one slot."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"common words around slot {s} v{rng.randrange(3)}s{s} end" for s in range(40))) for i in range(n)]
    return [*rows, (n, rows[n // 2][1].replace("s39 end", "x39 end"))]


@pytest.mark.parametrize("second", [None, 1])
def test_near_duplicates_in_templates(spark, monkeypatch, second):
    """With the rounds as shipped; and with second postings for all lists of several blocks."""
    if second:
        monkeypatch.setattr(near_dedup, "SECOND", second)
        monkeypatch.setattr(near_dedup, "BLOCK", 50)
    rows = templated(700)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == near_dedup.brute_force(rows) and got[700][1:] == (350, False)


def test_near_duplicates_when_a_pivot_round_finds_nothing(spark, monkeypatch):
    """Links that no pivot meets are found by the whole comparison, whether or not a round before it found one."""
    def blind(batches):
        yield from (b.select([0, 1, 2, 3]).slice(0, 0) for b in batches)

    assert near_dedup.ROUNDS == 2
    monkeypatch.setattr(near_dedup, "colliding", blind)  # no pivot pair is ever confirmed
    template = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join([*template, f"own{i}"])) for i in range(8)]
    want = near_dedup.brute_force(rows)
    assert len({c for _, c, _ in want.values()}) == 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("length", [12, 40, 400])
def test_repeats_match_counting_every_string(spark, length):
    passage = text(120)
    rows = [(i, text(RNG.randint(0, 200)) + (passage[RNG.randint(0, 50) :] if i % 5 == 0 else "")) for i in range(60)]
    rows += [(200, rows[3][1]), (201, "ab" * 500), (202, "é" * 300)] + EDGES
    zero = F.lit(0).cast("long")
    out = suffix_dedup.remove_repeats(frame(spark, rows), length).select("doc_id", "n_bytes", F.coalesce("n_removed", zero), F.coalesce("n_spans", zero), F.coalesce(F.sha2("kept", 256), "whole_sha"))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == suffix_dedup.brute_force(rows, length)


def test_difference_sets_cover():
    for length in (12, 40, 100, 400):
        levels, v, cover = suffix_dedup.plan(length)
        assert {(i - j) % v for i in cover for j in cover} == set(range(v))
        assert v - 1 + 3**levels <= length


def test_decontamination_in_one_part_and_in_many(spark):
    items = [(1, text(30)), (2, text(5)), (3, None), (4, "..."), (5, text(13)), (10, None), (None, text(20))]
    items.append((6, items[0][1]))
    rows = [(i, "é. " * (i % 4) + text(RNG.randint(0, 60)) + (". " + RNG.choice([*items[:2], items[6]])[1].upper() + "! " if i % 3 == 0 else "")) for i in range(40)] + EDGES
    rows += [(7, rows[0][1]), (None, rows[3][1])]
    docs = frame(spark, rows)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    want = sorted((-1 if i is None else i, *decontaminate.brute_force(t, items)) for i, t in rows)
    for most in (10**6, 60):
        out = decontaminate.scan(docs, benchmark, most)
        digest = out.select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), decontaminate.contaminated())
        assert sorted(tuple(r) for r in digest.collect()) == want
        texts = {i: t for i, t in rows if i not in (7, None)}
        for r in out.where("n_hit > 0").collect():
            if t := texts.get(r["doc_id"]):  # the code points of a hit hold its words
                words = decontaminate.words_of(t.encode())
                assert [decontaminate.words_of(t[o["start"] : o["end"]].encode()) for o in r["offsets"]] == [words[s["first"] : s["end"]] for s in r["spans"]]
                assert all(t[o["start"]].isalnum() and t[o["end"] - 1].isalnum() for o in r["offsets"])
        kept = decontaminate.drop_contaminated(docs, benchmark, most)
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [w[0] for w in want if not w[5]]
        assert kept.columns == ["doc_id", "text", "key"]


def test_secrets(spark):
    hexa = "".join(RNG.choice("0123456789abcdef") for _ in range(40))
    rows = [(1, f'x password = "{hexa}" y'), (2, "AKIA" + "A1" * 9 + " AKIA12"), (3, f"é{hexa}é TOKEN:abc token=abcdefgh"), (4, "the login key is Zx9!qLw7#vB2 now"), (5, "the secret is tokenisation and the password is password123"), *EDGES]
    known = {"tokenisation": 1}
    got = {r["doc_id"]: r for r in secrets.scan(frame(spark, rows), words=known).withColumn("sha", F.sha2("base", 256)).collect()}
    for i, t in rows:
        assert got[i]["sha"] == secrets.brute_force_base(t)
    assert (got[1]["n_assign"], got[2]["n_access"], got[3]["n_hex"], got[3]["n_assign"]) == (1, 1, 1, 1)
    assert "guess:17:29" in got[4]["spans"] and got[5]["spans"] == ""
    clean = {r["doc_id"]: r for r in secrets.redact(frame(spark, rows).withColumn("n_chars", F.length("text")), known).collect()}
    assert hexa not in clean[1]["text"] and clean[5]["text"] == rows[4][1] and clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[100000]["text"] is None


KNOWN = {w: i + 1 for i, w in enumerate("required authentication tokenisation bearing".split())}


def test_random_letters_are_no_words():
    def cost(value):
        return secrets.guess_cost(value, KNOWN)

    assert min(cost("hvqkzmxw7"), cost("xkqzvbnwrtyplkjh")) > secrets.MIN_LOG10 > max(cost("authentication"), cost("Required"), cost("tokenisation"))
    for context in ("pwd: ", "pin=", "kennwort: ", "clave = ", "bearer ", "login: ", "key: ", "the password is "):
        for value, secret in (("hvqkzmxw7", True), ("xkqzvbnwrtyplkjh", True), ("required", False)):
            t = f"a {context}{value} b"
            assert bool(secrets.guessed_spans(t, t.encode().lower(), KNOWN)) == secret, t
    for t, secret in (("the key mechanismus of it", False), ("token-xkqzvbn9wrtyplkjh x", True), ("key: a.b?token=xkqzvbnw9rtyplkjh", True), ("api_key_prod = Zx9qLw7vB2mm", True)):
        assert bool(secrets.guessed_spans(t, t.encode().lower(), KNOWN)) == secret, t


def plain_cost(value: str) -> float:
    """The cheapest segmentation by trying every one, with each kind of segment judged alone."""
    low, plain = value.lower(), value.lower().translate(secrets.LEET)
    brute = secrets.alphabet(value)

    def segment(s: int, e: int) -> float:
        part, found = value[s:e], [secrets.word_cost(value[s:e], low[s:e], plain[s:e], KNOWN)] if e - s >= 3 else []
        if e - s == 1:
            found.append(brute)
        if e - s >= 3:
            if len(set(part)) == 1:
                found.append(brute + secrets.REPEAT)
            if {ord(b) - ord(a) for a, b in zip(part, part[1:])} in ({1}, {-1}):
                found.append(secrets.SEQUENCE)
            if all(p in secrets.NEAR for p in zip(low[s:e], low[s + 1 : e])):
                found.append(secrets.WALK + secrets.STEP * (e - s))
        if part[0].isdigit() and (m := secrets.DATE.match(value, s)) and m.end() == e:
            found.append(secrets.DAY if e - s > 4 else secrets.YEAR)
        return min(found, default=float("inf"))

    best = [0.0]
    for e in range(1, len(value) + 1):
        best.append(min(best[s] + segment(s, e) for s in range(e)))
    return best[-1]


def test_guess_costs_are_the_cheapest_segmentation():
    rng = random.Random(23)
    parts = ["password", "Required", "tokenisation", "aaaa", "ddd", "qwert", "1234", "4321", "1999-12-31", "2024", "x", "7", "Q", "!", "p4ssw0rd", "bearing", "zyx", "été", "ß"]
    for _ in range(400):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        want = plain_cost(value)
        assert secrets.guess_cost(value, KNOWN) == pytest.approx(want, abs=1e-9), value
        assert (secrets.guess_cost(value, KNOWN, 8.0) >= 8.0) == (want >= 8.0 - 1e-12), value


def test_secret_scans_are_linear():
    import time

    for t in ("key." * 60_000, "key " * 60_000, "key=aaaa" * 30_000, "token=" + "password" * 30_000, "token-" * 40_000, "key: " + "x9" * 120_000):
        began = time.time()
        secrets.guessed_spans(t, t.encode().lower(), KNOWN)
        assert time.time() - began < 10


def test_words_of_texts_are_learnt(spark):
    rows = [(i, f"the Datenschutz of mechanisms {i}. key: hvqkzmxwpl") for i in range(5)]
    words = secrets.dictionary(frame(spark, rows))
    assert {"datenschutz", "mechanisms"} <= set(words) and "hvqkzmxwpl" not in words
    rows.append((9, "the password is mechanisms"))
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(spark, rows)).collect()}
    assert spans[9] == "" and all(f"guess:{rows[i][1].index('hv')}:" in spans[i] for i in range(5))


def test_guess_costs_are_ordered():
    cost = secrets.guess_cost
    assert cost("") == 0
    assert cost("password") < cost("password1999-01-01") < cost("b7db7aa4a5fcc78305")
    assert max(cost("aaaaaaaaaaaa"), cost("qwertyuiop"), cost("123456789")) < 6
    assert cost("x9" * 5000) > 1000


def test_sanitisation(spark):
    frag = ["a@b.c", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (988) 555-2485", " ", "@", "..", "é", "😀", "12", "+", "a@b.c%d@e.f"]
    rows = [(i, "".join(RNG.choice(frag) for _ in range(RNG.randint(0, 20)))) for i in range(200)] + EDGES
    rows += [(9000 + i, f"w{'abcdefghijkl'[i]}x the codename Bluefinch met agent@corp.example over {'stuvwxyzabcd'[i]}tea and of the") for i in range(12)]
    rows += [(9100 + i, "the common words over and of the plain kind") for i in range(60)] + [(9900, "Bluefinch alone")]
    rows += [(9901, "1.2.3.4 " * 2000)]
    got = {r["doc_id"]: r for r in pii.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        assert [tuple(s) for s in got[i]["base"]] == pii.brute_force_base(t)
    assert [(s["start"], s["end"]) for s in got[9900]["terms"]] == [(0, 9)]
    assert not got[9100]["terms"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, rows)).collect()}
    assert "agent@corp" not in clean[9000] and "Bluefinch" not in clean[9900] and clean[9100] == rows[-62][1]


def test_language_model_scores(spark, monkeypatch):
    rows = [(i, text(RNG.randint(0, 40))) for i in range(200)] + EDGES
    docs = frame(spark, rows)
    trie = lm_score.train(docs, shared.new_path(spark, "trie"), 5)
    got = {r[0]: tuple(r)[1:] for r in lm_score.score(docs, trie).collect()}
    want = lm_score.brute_force(rows)
    tokens = [[None, *(t or "").encode().lower().split(), b""] for i, t in rows if lm_score.training(i)]
    numbers, logp = trie.pairs.successors(trie.words.size)  # after the start of a text
    assert len(numbers) == len({ws[1] for ws in tokens}) and (np.diff(numbers) > 0).all() and 0.5 < (10**logp).sum() <= 1.001
    pairs, triples = ({g for ws in tokens for g in zip(*(ws[i:] for i in range(n)))} for n in (2, 3))
    assert sum(len(trie.pairs.successors(v)[0]) for v in range(trie.words.size + 1)) == len(pairs) == trie.pairs.firsts[-1]
    assert sum(len(trie.triples.successors(v)[0]) for v in range(len(pairs))) == len(triples) == trie.triples.firsts[-1]
    for i in want:
        assert got[i][:4] == want[i][:4]
        assert got[i][4] == pytest.approx(want[i][4], abs=1e-9 * want[i][1] + 1e-9)
        assert got[i][5] == pytest.approx(want[i][5], abs=2e-4 * want[i][1])
    held = [w for w in want.values() if w[0]]
    assert sum(w[5] for w in held) > sum(w[4] for w in held)
    monkeypatch.setattr(lm_score, "TOKENS_A_PART", 1000)
    again = {r[0]: tuple(r)[1:] for r in lm_score.score(docs, lm_score.train(docs, shared.new_path(spark, "trie"))).collect()}
    assert all(again[i] == pytest.approx(got[i], abs=1e-6) for i in want)  # however many ranges


def test_word_prints_do_not_depend_on_pieces(monkeypatch):
    raws = [" ".join(RNG.choice(WORDS) for _ in range(40)).encode() + b" \t\n" + b"y" * n for n in (0, 3, 100)] + [b"", b"  ", "é\x00A".encode()]
    want = lm_score.tokens_of(raws)
    assert want[0].tolist() == [len(r.split()) + 1 for r in raws]
    monkeypatch.setattr(lm_score, "PIECE", 16)
    got = lm_score.tokens_of(raws)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
    words = [w for r in raws for w in [*r.lower().split(), b""]]
    assert len(set(words)) == len(set(want[1].tolist())) == len(set(zip(words, want[1].tolist(), strict=True)))


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, universe in ((0, 10), (1, 1), (3000, 1 << 40), (3000, 4000), (500, 100000)):
        v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        e = EliasFano(encode(v, universe))
        assert (e.get(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, universe, 500, dtype=np.uint64)])
        at = np.searchsorted(v, q)
        assert (e.find(q) == [a if a < n and v[a] == x else -1 for a, x in zip(at, q, strict=True)]).all()


def test_url_filter(spark):
    urls = ["http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "https://a.b.example.com/en/1", "http://x.net/es/1", "http://net/fr/", "http://x.net", "nothing", None, "", "http://notexample.com/en/", "http://com/", "a://b://c/d", "http://example.com:80/en/", "http://..com/x"]
    rows = [(i, u) for i, u in enumerate(urls * 20)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, key string")
    rules = [*url_filter.RULES, ("example.com", "/", "allow"), ("www.example.com", "/en/", "block"), ("Example.com", "/en/x", "allow")]
    for ranges in (1, 7):
        got = {r[0]: tuple(r)[1:] for r in url_filter.judge_pages(pages, spark.createDataFrame(rules, "host string, path string, action string"), ranges=ranges).collect()}
        lowered = [(h.lower(), p, a) for h, p, a in rules]
        assert got == {i: url_filter.brute_force(u, lowered) for i, u in rows}


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 16))
    x = (centres[rng.integers(0, 8, 1500)] + 0.3 * rng.standard_normal((1500, 16))).astype(np.float32)
    x[100:600] = x[100]  # one vector of a third of all rows
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000, None, 1), (9020, [0.0] * 16, 1), (9040, [float("nan")] * 16, 1), (9060, [1.0, None] * 8, 1), (9080, [1.0], 1), (9100, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got: dict[int, list] = {}
    for r in neighbours.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        scores = x.astype(np.float64) @ x[q].astype(np.float64)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(scores, 9)))[:20]
        hit += len(set(best.tolist()) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        for _, v, s in found:
            assert s == pytest.approx(scores[v], abs=1e-9)
    assert hit >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in neighbours.nearest_neighbours(few, few).collect()) == [(0, 1, 20, 4.0), (20, 1, 0, 4.0)]


def test_pieces_are_sentencepiece_and_come_back(spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = [(i, "".join(RNG.choice(" \nabcdefghijklmnopqrstuvwxyzéß😀0123.,") for _ in range(RNG.randint(1, 80)))) for i in range(200)] + EDGES + [(500, "\x00<0x41> ▁x"), (501, "y" * 3000)]
    out = pieces.encoded(frame(spark, rows))
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in rows:
        assert got[i]["ids"] == (p.encode(t) if t else []) and got[i]["n_tokens"] == len(got[i]["ids"])
        assert got[i]["round_trip"] == ("▁" not in (t or ""))  # the space mark itself comes back as a space
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(out).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)


def test_quality(spark):
    good = [(i, "en", text(60)) for i in range(200)]
    bad = [(1000 + i, "en", " ".join(f"{w.upper()}$$##" for w in text(40).split())) for i in range(20)]
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in [*good, *bad, (2000, None, text(50)), (2001, "en", None), (2002, "en", " ")]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(1000, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert all(got[i]["rejected"] for i, _, _ in bad) and sum(got[i]["rejected"] for i, _, _ in good) <= 2
    assert got[2001]["rejected"] and got[2002]["rejected"] and got[2001]["perplexity"] is None and not got[2000]["rejected"]
    model = quality.train(docs.where("doc_id < 100"))
    one, other = ({r["doc_id"]: (r["n_symbols"], r["logp"]) for r in quality.score(docs, model, most).collect()} for most in (10**6, 0))
    assert one.keys() == other.keys()
    for i in one:
        assert one[i][0] == other[i][0] and one[i][1] == pytest.approx(other[i][1], abs=1e-6)
    # probabilities of the characters after a context sum to one, with what backs off
    rows = {(r["order"], r["g"]): r for r in model.collect()}
    alphabet = [g for (o, g), r in rows.items() if o == 1 and r["logp"] is not None]

    def p(g: str) -> float:
        if g == "":
            return 10 ** rows[-1, ""]["logp"]
        if (len(g), g) in rows and rows[len(g), g]["logp"] is not None:
            return 10 ** rows[len(g), g]["logp"]
        context = rows.get((len(g) - 1, g[:-1]))
        return (10 ** context["back"] if context is not None and context["back"] is not None else 1.0) * p(g[1:])

    for context in ("", "k", "ka", "zzz"):
        total = sum(p(context + c) for c in alphabet) + p(context + "\uffff")
        assert total == pytest.approx(1.0, abs=1e-6)


def plain_kneser_ney(texts: list[str], order: int):
    """log10 P of a text by interpolated modified Kneser-Ney with dictionaries: every level interpolated at each character."""
    import math
    from collections import Counter, defaultdict

    units = [quality.unit_of(t) for t in texts if quality.unit_of(t)]
    counts = {order: Counter(u[i : i + order] for u in units for i in range(len(u) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])  # distinct characters before
    levels = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        else:
            d = [0.5, 0.75, 0.9]
        total, mass = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            mass[g[:-1]] += d[min(v, 3) - 1]
        levels[n] = c, d, total, mass
    alphabet = len(counts[1]) + 1

    def p(g: str) -> float:
        if not g:
            return 1 / alphabet
        c, d, total, mass = levels[len(g)]
        h = g[:-1]
        if not total[h]:
            return p(g[1:])
        return (c[g] - d[min(c[g], 3) - 1] if c[g] else 0) / total[h] + mass[h] / total[h] * p(g[1:])

    return lambda t: sum(math.log10(p(u[i : i + order])) for u in [quality.unit_of(t)] for i in range(len(u) - order + 1))


def test_quality_model_is_kneser_ney(spark):
    texts = [text(RNG.randint(1, 30)) for _ in range(60)] + ["", None, "é a", "aaaa aaaa"]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = plain_kneser_ney(texts, quality.ORDER)
    asked = [*texts[:10], "unseen Zeichen 漢字", "é a", "k", text(20).upper(), " \t ", None, texts[0]]
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(asked)], "doc_id long, text string, lang string, g string")
    for most in (10**6, 0):
        got = {r["doc_id"]: r["logp"] for r in quality.score(docs, model, most).collect()}
        for i, t in enumerate(asked):
            assert got[i] == pytest.approx(want(t), abs=1e-6), t


def test_quality_of_repeated_rows_and_ties(spark):
    rows = [(i, text(40), "en") for i in range(80)]
    rows += [rows[0], (0, "ZZQ$$ " * 40, "en"), (None, rows[1][1], None), (200, rows[2][1] * 300, "en")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, order string, logp double")
    labels = spark.createDataFrame([(i, 1, None) for i in range(80)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    own = [r["rejected"] for r in got if r["doc_id"] == 0]
    assert sorted(own) == [False, False, True]  # the rows of one id are judged by their own texts


def test_quality_reads_across_words(spark):
    good = [(i, "en", ". ".join(text(8).capitalize() for _ in range(12))) for i in range(300)]
    word = max(WORDS, key=len)
    loops = [(1000, "en", " ".join([word.capitalize()] * 120)), (1001, "en", " ".join([word] * 120))]
    toxic = [(2000 + i, "en", f"{word.upper()}ZZQ! " * 40) for i in range(3)]
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in [*good, *loops, *toxic]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(i, 1, 1) for i, _, _ in toxic[:1]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert all(got[i]["rejected"] for i, _, _ in loops) and sum(got[i]["rejected"] for i, _, _ in good) <= 6
    assert all(got[i]["rejected"] for i, _, _ in toxic)
    # one text of the words a, b is no sum of its words: what stands before counts
    model = quality.train(docs.where("doc_id < 300"))
    one, swapped = (r["logp"] for r in quality.score(spark.createDataFrame([(1, good[0][2], "en"), (2, " ".join(reversed(good[0][2].split())), "en")], "doc_id long, text string, lang string"), model).orderBy("doc_id").collect())
    assert one > swapped


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_dedup.near_duplicates(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert decontaminate.scan(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert secrets.scan(docs).count() == 0 and pii.scan(docs).count() == 0 and pieces.encoded(docs).count() == 0
    assert lm_score.score(docs, lm_score.train(docs, shared.new_path(spark, "trie"), 3)).count() == 0
    assert quality.classify(docs, labels).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(vectors, vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_pages(pages, spark.createDataFrame(url_filter.RULES, "host string, path string, action string")).count() == 0


def test_repeated_rows(spark):
    """Rows that stand twice, and rows that share an id: every row comes back once, with its own text's result."""
    passage = text(150)
    rows = [(1, "a " + passage), (1, "a " + passage), (2, "b " + passage), (2, "c c"), (3, None), (3, None), (None, "d " + passage), (4, "mail x@y.zz"), (4, "mail x@y.zz"), (4, "no mail")]
    docs = frame(spark, rows)
    cut = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs, 100).collect()]
    assert len(cut) == len(rows)
    assert sorted(c[1:] for c in cut if c[0] == 1) == [(len(rows[0][1]), len(rows[0][1]))] * 2
    assert sorted((c[2] or 0) > 0 for c in cut if c[0] == 2) == [False, True]
    assert near_dedup.near_duplicates(docs).count() == len(rows)
    found = pii.scan(docs).collect()
    assert len(found) == len(rows) and sorted(len(r["base"]) for r in found if r["doc_id"] == 4) == [0, 1, 1]
    assert sorted(r["text"] for r in pii.sanitised(docs).where("doc_id = 4").collect()) == ["mail [EMAIL]", "mail [EMAIL]", "no mail"]
    for out in (secrets.scan(docs), pieces.encoded(docs), lm_score.score(docs, lm_score.train(docs, shared.new_path(spark, "trie"), 3))):
        assert out.count() == len(rows)


def test_suffix_names_by_two_keys():
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 99, 4000, np.uint8).tobytes() * 2 + b"tail" * 300
    length = 400
    at = np.arange(len(raw) - length + 1)
    strings = [raw[i : i + length] for i in at]
    first, second = (suffix_dedup.names_at(raw, at, length, key) for key in (0, 1))
    for names in (first, second):  # equal names are equal strings
        assert len(set(zip(names.tolist(), strings, strict=True))) == len(set(strings)) == len(set(names.tolist()))
    assert not np.intersect1d(first, second).size
    some = np.array([3, 7, 4003, 8500])
    assert (suffix_dedup.names_at(raw, some, length, 1) == second[some]).all()


def test_suffix_names_tell_exchanged_bytes_apart(spark):
    text = "".join(chr(97 + int(x)) for x in np.random.default_rng(3).integers(0, 26, 400))
    rows = [(0, text)]
    for i, (p, q) in enumerate([(1, 3), (2, 6), (5, 7), (37, 39)], 1):
        assert text[p] != text[q]
        rows.append((i, text[:p] + text[q] + text[p + 1 : q] + text[p] + text[q + 1 :]))
    for key in (0, 1):
        assert len({int(suffix_dedup.names_at(t.encode(), np.zeros(1, np.int64), 400, key)[0]) for _, t in rows}) == len(rows)
    docs = frame(spark, rows)
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()} == dict.fromkeys(range(5), 0)
