"""Personal data, importance draws and spelling groups against brute force and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventloom.llm import importance, pii, semi_crf, spelling
from eventloom.llm.common import LOWER, UPPER

CASE = str.maketrans(UPPER, LOWER)
DOCS = "doc_id long, text string"


# personal data

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and checksum(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def checksum(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def by_rule(text):
    return [(kind, *m.span()) for kind, (p, fits) in RULES.items() for m in re.finditer(p, text) if fits(m[0])]


def test_rules_equal_their_patterns():
    rng = random.Random(4)
    bits = ["a", "B9", "@", ".", "+", "-", " ", "1", "22", "255", "256", "4111 1111 1111 1111", "4111111111111112", "(", ")", "%", "_", "é", "x.org", "\n", "00", "😀", "m@x.de"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert pii.base_spans(text) == by_rule(text), text


def test_rules_are_linear_in_the_text():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "@" * 300_000, "a@b" * 100_000):
        pii.base_spans(text)
        list(pii.windows(text))


def personal(n, seed):
    """Texts with known data, each on its own, with numbers that mean nothing."""
    rng = random.Random(seed)
    words = "the and of house river over went later green small said with under".split()

    def card():
        digits = "".join(rng.choices("0123456789", k=15))
        return digits + next(c for c in "0123456789" if checksum(digits + c))

    rows = []
    for i in range(n):
        what = (
            f"{rng.choice(words)}.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
            card(), f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", "".join(rng.choices("123456789", k=rng.randint(7, 18))), hashlib.sha1(str(i).encode()).hexdigest(),
        )[i % 6]
        rows.append(" ".join([*rng.choices(words, k=rng.randint(3, 12)), what, *rng.choices(words, k=rng.randint(3, 12))]))
    return rows


@pytest.fixture(scope="module")
def field():
    return pii.train([t[a:b] for t in personal(500, 1) for a, b in pii.windows(t)])


def test_field_finds_other_spellings_and_leaves_clean_texts(field):
    held = [x for t in personal(240, 2) for x in pii.lessons(t)]
    right = wrong = missed = 0
    for k in range(0, len(held), 64):
        for x, found in zip(held[k : k + 64], field.decode(held[k : k + 64])):
            sure = {(i, n, kind) for i, n, kind, p in found if p >= pii.SURE}
            right, wrong, missed = right + len(sure & set(x.gold)), wrong + len(sure - set(x.gold)), missed + len(set(x.gold) - sure)
    assert right / (right + missed) > 0.9 and wrong / (right + wrong) < 0.03
    clean = ["", "plain words", "we met at noon. Then left", "on 2024-05-17 10:30:22 it", "order 8035555351 shipped", "1 2 3 4 5 6 7 8 9 10 11", "9914969043960559 x"]
    assert pii.added_spans(clean, [pii.base_spans(t) for t in clean], field) == [[] for _ in clean]
    # two cards that the rule reads as one long number
    two = "pay 4111111111111111 4012888888881881 now"
    assert pii.base_spans(two) == [] and pii.added_spans([two], [[]], field) == [[("card", 4, 20), ("card", 21, 37)]]


def test_dynamic_programs_equal_enumeration():
    rng = np.random.default_rng(0)
    model = semi_crf.SemiCrf(2)
    model.entity, model.outside, model.next = rng.normal(size=model.entity.shape), rng.normal(size=semi_crf.SPACE), rng.normal(size=(3, 3))
    model.next[0, 0] = 0
    batch = []
    for n in (1, 3, 5):
        spans = [(i, k) for i in range(n) for k in range(1, n - i + 1) if rng.random() < 0.8]
        batch.append(semi_crf.Lattice(rng.integers(0, semi_crf.SPACE, (n, 3)), np.array([s for s, _ in spans], int), np.array([k for _, k in spans], int), rng.integers(0, semi_crf.SPACE, (len(spans), 11))))

    def paths(x, at, before):
        n = len(x.tokens)
        if at == n:
            yield 0.0, []
            return
        for score, rest in paths(x, at + 1, 0):
            yield score + model.next[before, 0] + model.outside[x.tokens[at]].sum(), rest
        for s, (i, k) in enumerate(zip(x.starts, x.lengths)):
            if i == at:
                for kind in (1, 2):
                    for score, rest in paths(x, at + k, kind):
                        yield score + model.next[before, kind] + model.entity[kind - 1, x.segments[s]].sum(), [(int(i), int(k), kind), *rest]

    outside, entity, pads = model.scores(batch)
    total, seg, _, _ = model.marginals(outside, entity)
    for b, (x, best) in enumerate(zip(batch, model.decode(batch))):
        every = list(paths(x, 0, 0))
        z = math.log(sum(math.exp(s) for s, _ in every))
        assert abs(z - total[b]) < 1e-8
        assert [f[:3] for f in best] == max(every, key=lambda e: e[0])[1]
        for i, k, kind, p in best:
            assert abs(p - sum(math.exp(s - z) for s, path in every if (i, k, kind) in path)) < 1e-8


def test_personal_data_on_odd_rows(spark, field):
    card, mail = "4111 1111 1111 1111", "ä a@b.org"
    long = ("word " * 60_000) + "a.b@mail1.example.com"
    rows = [(1, mail, "x"), (1, mail, "x"), (None, card, "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (5, mail + " " + card, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end, s.text, s.rule) for s in r.spans]) for r in pii.find_spans(df, field).collect()), key=str)
    m = ("email", 2, 9, "a@b.org", True)
    assert got == sorted(
        [(1, [m]), (1, [m]), (None, [("card", 0, 19, card, True)]), (2, []), (3, []), (4, [("email", 300_000, 300_021, "a.b@mail1.example.com", True)]), (5, [m, ("card", 10, 29, card, True)])],
        key=str,
    )
    hidden = {r.text for r in pii.mask_documents(df.filter("doc_id in (1, 2, 5)"), field).collect()}
    assert hidden == {"ä [EMAIL]", None, "ä [EMAIL] [CARD]"}
    assert pii.find_spans(df.limit(0), field).count() == 0 and pii.fit(df.limit(0)) is None
    assert pii.find_spans(df, None).count() == len(rows)


def test_personal_data_query(spark, tmp_path):
    texts = [*personal(60, 5), None, ""]
    spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op11_personal_data(spark, str(tmp_path)).collect():
        base = by_rule(texts[r.doc_id] or "")
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(told.split(",")) <= set(r.spans.split(",")) | {""}
        assert r.n_added == len([s for s in r.spans.split(",") if s]) - len(base)


def test_training_windows_are_bounded_and_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(list(enumerate(personal(200, 7) * 2)), DOCS)
    one, many = (sorted(r.window for r in pii.training_windows(df.repartition(n), "text", 40).collect()) for n in (1, 7))
    assert one == many and len(one) == 40 == len(set(one))


# importance


def draw_by_hand(docs, target, percent=10, least=20, buckets=10_000, ngram=1):
    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(CASE))

    def grams(found):
        return [" ".join(found[i : i + n]) for n in range(1, ngram + 1) for i in range(len(found) - n + 1)]

    def slot(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(slot(f) for _, x in docs for f in grams(words(x))), Counter(slot(f) for x in target for f in grams(words(x)))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        found = words(x)
        weight = sum(gain[slot(f)] for f in grams(found))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(grams(found)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(found) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def sample_texts(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéß0ñ", k=rng.randint(1, 6))) for _ in range(400)]
    return [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60))).title() + rng.choice(("", "\n--", "\x00 z"))) for i in range(n)]


@pytest.mark.parametrize("ngram", [1, 2])
def test_importance_draw(spark, ngram):
    docs = sample_texts(150, 1)
    docs += [(150, None), (151, ""), (None, docs[3][1]), (7, docs[7][1]), (8, docs[9][1]), (152, "x y " * 30_000)] + [(9, docs[9][1])] * 30
    target = [x for _, x in sample_texts(20, 2)] + [None, ""]
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in docs], "doc_id long, text string, score string, rank int").repartition(3)
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    for percent in (10, 60):
        got = importance.importance_draw(df, wanted, percent, ngram=ngram)
        assert sorted((tuple(r) for r in got.collect()), key=str) == draw_by_hand(docs, target, percent, ngram=ngram)
    drawn = importance.drawn_documents(df, got)
    assert drawn.columns == df.columns and drawn.count() > 30


def test_importance_of_nothing(spark):
    df, none = spark.createDataFrame(sample_texts(5, 3), DOCS), spark.createDataFrame([], "text string")
    assert importance.importance_draw(df.limit(0), none).count() == 0
    assert {r["rank"] for r in importance.importance_draw(df, none).collect()} == {None}


def test_rank_offsets_over_the_whole_range(spark):
    rng = random.Random(1)
    scores = {rng.randint(-(1 << rng.randint(1, 62)), 1 << rng.randint(1, 62)) for _ in range(300)} | {0, -1, 1, -(1 << 63), (1 << 63) - 1}
    rows = [(s, rng.randint(1, 5)) for s in scores]
    got = {r.score: r.offset for r in importance.rank_offsets(spark.createDataFrame(rows, "score long, n long")).collect()}
    assert got == {s: sum(n for other, n in rows if other > s) for s in scores}


# spelling


def groups_by_hand(docs, least=3, letters=5, times=2):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CASE)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= letters
    n = {w: c for w, c in n.items() if c >= least}
    near, cut = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            cut[k, short].add(w)
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for same in cut.values():
        for w in same:
            near[w] |= same - {w}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= times * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n)


def variants(seed, count=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéÿ", k=rng.randint(4, 9))) for _ in range(count)]
    # many words that share their first or last half
    vocab += ["abcab" + "".join(rng.choices("abc", k=rng.randint(3, 6))) for _ in range(count)] + ["".join(rng.choices("ab", k=rng.randint(3, 6))) + "cabca" for _ in range(count)]
    weights = [rng.choice((1, 1, 4, 20)) for _ in vocab]
    return [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 120))).replace(" e", rng.choice((" E", ", ", " 1")))) for i in range(80)]


@pytest.mark.parametrize("hot", [spelling.HOT, 6])
def test_spelling_groups(spark, hot):
    docs = variants(3)
    docs += [(None, docs[0][1]), (1, docs[1][1]), (90, None), (91, ""), (92, "Überlang" * 30_000), (93, "İstanbul x×y÷z 😀bcdefg " * 4)]
    df = spark.createDataFrame([(i, t, "a") for i, t in docs], "doc_id long, text string, word string").repartition(3)
    got = spelling.spelling_groups(df, hot=hot).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect())) == groups_by_hand(docs)
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_hot_segments_are_cut_until_they_are_small(spark):
    """Words that share nearly everything: no key keeps more than it can have letters."""
    words = [f"prefix{a}{b}{c}suffix" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    entries = spelling.refined(spelling.filed(df), hot=20)
    assert entries.groupBy("key").count().filter("count > 64").isEmpty()
    got = spelling.near_words(df, hot=20, shard_entries=100).groupBy("word").count().collect()
    assert len(got) == 512 and {r["count"] for r in got} == {21}


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(2))
        cuts = lambda w: {(k, w[:k] + w[k + 1 :]) for k in range(len(w))}
        want = a != b and bool(cuts(a) & cuts(b) if len(a) == len(b) else a in {c for _, c in cuts(b)} or b in {c for _, c in cuts(a)})
        assert spelling.one_edit(a, b) == want, (a, b)


def test_one_edit_of_many_words():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abÿ", k=rng.randint(3, 6))) for _ in range(300)})
    for size in (3, 4, 5):
        owners = [w for w in words if len(w) == size]
        near = [w for w in words if abs(len(w) - size) < 2]
        assert set(spelling.one_edit_pairs(owners, near)) == {(x, y) for x in near for y in owners if spelling.one_edit(x, y)}
