"""Language, toxicity and secrets."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from kerbline.llm import language, secrets, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {"en": "the house is on green hill and water flows by stone".split(),
         "de": "das haus steht auf dem grünen hügel und wasser fließt".split(),
         "fr": "la maison est près de colline verte où coule été".split()}


def _texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 40))), lang)
            for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def _segmentations(word):
    for cut in range(1 << (len(word) - 1)):
        parts, at = [], 0
        for i in range(1, len(word)):
            if cut >> (i - 1) & 1:
                parts.append(word[at:i])
                at = i
        yield parts + [word[at:]]


def test_forward_sums_all_segmentations():
    pieces = language.pieces_of(MODEL)
    model = language.Unigrams(pieces, ["a", "b"], np.random.default_rng(2).random((len(pieces) + 1, 2)))
    number = {p: i for i, p in enumerate(pieces)}
    for word in ("the", "hello", "ñandú", "x", "日本"):
        total = np.zeros(2)
        for parts in _segmentations("▁" + word):
            numbers = [number.get(p, model.other if len(p) == 1 else None) for p in parts]
            if None not in numbers:
                total += np.prod(model.p[numbers], axis=0)
        assert np.allclose(model.solve([word])[0], np.log(total))
    long = "straße" * 2000
    assert np.isfinite(model.solve([long, "a"])).all()


def test_expected_counts_raise_the_likelihood():
    words = sorted({w for ws in WORDS.values() for w in ws})
    weights = np.array([[w in WORDS[lang] for lang in sorted(WORDS)] for w in words], dtype=float)
    model = language.Unigrams(language.pieces_of(MODEL), sorted(WORDS))
    last = -np.inf
    for _ in range(3):
        now = (model.solve(words) * weights).sum()
        assert now > last
        last = now
        model.fit(words, weights, rounds=1, smooth=1e-9)


def test_language_report(spark):
    rows = _texts(600) + [(1000, None, "en"), (1001, "", "de"), (1002, "123 ... ½", "fr"), (1003, "das haus", None),
                          (None, "la maison est verte", "fr"), (1004, "the house " * 20000, "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = language.language_report(docs, MODEL).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, t, lang in rows if i is not None and i < 1000}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und"] * 3 + ["de", "en", "fr"]
    assert all(0 <= r.score <= 1 for r in got)
    assert language.language_report(docs.limit(0), MODEL).count() == 0
    assert {r.lang_pred for r in language.language_report(docs.where("lang is null"), MODEL).collect()} == {"und"}


def test_known_language(spark):
    rows = _texts(200) + [(900, None, "en"), (901, "12 34", "en"), (902, "la maison", None)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows],
                                 "doc_id long, text string, lang string, score double, lang_pred string")
    kept = language.known_language(docs, MODEL)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - {900, 901}
    assert {r.doc_id for r in language.known_language(docs.where("lang is null"), MODEL).collect()} == {902}


def test_copies_are_drawn_one_by_one(spark):
    texts = [f"das haus steht {w}" for w in ("hier", "dort", "oben", "unten", "links")]
    rows = [(i, t, f"l{k}") for k, t in enumerate(texts) for i in range(k * 500, k * 500 + 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, MODEL, rows_per_language=50)
    assert (model.p.max(axis=0) > 2 * model.p.min(axis=0)).all()


def _toxic(n=1500, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices([f"wort{k}x" for k in range(400)], k=rng.randint(5, 60))
        bad = rng.random() < 0.15
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["scoundrel", "wretched", "vermin"])
        docs.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, 1, int(bad)))
    return docs, labels, {i: any(w in t for w in ("scoundrel", "wretched", "vermin")) for i, t in docs}


def test_toxicity(spark):
    docs, labels, truth = _toxic()
    rows = docs + [(5000, None), (5001, ""), (None, "scoundrel"), (3, docs[3][1])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (7000, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(table, marks).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    yes, no = [r for r in held if truth[r.doc_id]], [r for r in held if not truth[r.doc_id]]
    assert sum(r.predicted for r in yes) / len(yes) > 0.9 and sum(r.predicted for r in no) / len(no) < 0.02
    flipped = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in labels]
    other = toxicity.toxicity_report(table, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert sorted(map(str, other.collect())) == sorted(
        map(str, toxicity.toxicity_report(table, marks.where("doc_id is not null and toxic is not null")).collect()))
    assert toxicity.toxicity_report(table.limit(0), marks).count() == 0
    assert {r.predicted for r in toxicity.toxicity_report(table, marks.limit(0)).collect()} == {0}


def _name(k):
    return "wort" + "".join(chr(97 + k // 26 ** i % 26) for i in range(2))


@pytest.mark.parametrize("share", [0.3, 0.5])
def test_many_toxic_texts_are_told_apart(share):
    rng = np.random.default_rng(5)

    def text(bad):
        return " ".join([_name(k) for k in rng.integers(400, size=20)] + ["vermin", "wretched"][:int(bad)])

    model = toxicity.fit([toxicity.features(text(1)) for _ in range(300)],
                         [toxicity.features(text(rng.random() < share)) for _ in range(1000)], share)
    scores = model.score([text(1) for _ in range(200)] + [text(0) for _ in range(200)])
    assert (scores[:200] >= 0.7).mean() > 0.9 and (scores[200:] >= 0.7).mean() < 0.05


def test_words_that_clean_texts_share_count():
    rng = np.random.default_rng(6)

    def text(often):
        shared = [f"{_name(k)}geteilt" for k in np.flatnonzero(rng.random(30) < often)]
        return " ".join(shared + [_name(k + 50) for k in rng.integers(400, size=10)])

    positive, hidden = [text(0.3) for _ in range(500)], [text(0.3) for _ in range(300)]
    clean = [text(0.1) for _ in range(1700)]
    model = toxicity.fit([toxicity.features(t) for t in positive],
                         [toxicity.features(t) for t in hidden + clean], 0.15)
    scores = model.score([text(0.3) for _ in range(300)] + [text(0.1) for _ in range(300)])
    assert (scores[:300, None] > scores[None, 300:]).mean() > 0.9


def _plain_spans(text):
    out = []
    names = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|" \
            r"[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(names + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets(spark):
    rng = random.Random(8)
    key = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    texts = ["", None, "no secret here", 'Token = "abc"', 'paſſword: abcdef PASSWD="xyz.123=" secret:abcde', "é" * 9 +
             " api_key='A+/b_c-d' apikey=ABCDEFGH token=token=abcdefg", "AKIA" + "A" * 15, "AKIA" + "B7" * 8 + " x",
             "AKIAAKIA" + "0" * 20, "0123456789abcdef" * 3 + "g" + "a" * 23, "word " * 30000 + "secret=abcdefgh"]
    texts += [f"some words {key(24)} and more" for _ in range(40)]
    texts += [" ".join(rng.choices("lichkeit heit ingen schach unter donau dampf schiff".split(), k=40)) + " " +
              "".join(rng.choices("lich keit heit ingen schach".split(), k=6)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hex int")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert len(got) == len(texts)
    added = 0
    for i, t in enumerate(texts):
        spans, r = _plain_spans(t or ""), got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        shown = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        own = r.spans.split(",") if r.spans else []
        assert [s for s in own if not s.startswith("random")] == shown
        assert [int(s.split(":")[1]) for s in own] == sorted(int(s.split(":")[1]) for s in own)
        added += 11 <= i < 51 and any(s.startswith("random") for s in own)
        assert i >= 11 or len(own) == len(shown)
    assert added >= 36
    wrong = sum("random" in got[i].spans for i in range(51, len(texts)))
    assert wrong <= 6
    assert secrets.scan(docs.limit(0)).count() == 0


def test_random_strings_pass_and_words_do_not():
    rng = random.Random(1)
    assert sum(secrets.randomness(rng.randbytes(20).hex()) for _ in range(300)) > 290
    assert not secrets.randomness("a" * 40) and not secrets.randomness("abababababababababababab")
    assert secrets.measures("short") is None


@pytest.mark.parametrize("run,name", [("1" * 20, "decimal"), ("ab12" * 6, "hex"), ("AB12" * 6, "HEX"),
                                      ("AZ27" * 6, "base32"), ("xyz9" * 6, "lower36"), ("aB3+" * 6 + "==", "base64")])
def test_encodings(run, name):
    assert secrets.encoding(run) == name


_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_RANDOM_OVER = {"upper36": _UP + _DIG, "lower26": _LOW, "upper26": _UP, "letters52": _UP + _LOW,
                "alnum62": _UP + _LOW + _DIG, "base64": _UP + _LOW + _DIG + "+/", "base64url": _UP + _LOW + _DIG + "-_",
                "base32": _UP + "234567", "lower36": _LOW + _DIG, "hex": _DIG + "abcdef", "decimal": _DIG}


@pytest.mark.parametrize("name", sorted(_RANDOM_OVER))
def test_random_strings_pass_at_every_length(name):
    rng = random.Random(name)
    for n in (20, 32, 40, 64, 128, 256, 512, 1000, 1600, 3000, 5000):
        passed = sum(secrets.randomness("".join(rng.choices(_RANDOM_OVER[name], k=n))) for _ in range(100))
        assert passed >= 95, n
    assert secrets.encoding(_RANDOM_OVER[name]) == name


def test_scan_finds_random_strings_of_every_alphabet(spark):
    rng = random.Random(4)
    planted = ["".join(rng.choices(letters, k=n)) for _, letters in sorted(_RANDOM_OVER.items())
               for n in (128, 512, 2000) for _ in range(10)]
    words = ["".join(rng.choices("lich keit heit ingen schach".split(), k=rng.randint(5, 12))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(f"ein {t} wort" for t in planted + words)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert sum(bool(got[i]) for i in range(len(planted))) >= 0.97 * len(planted)
    assert sum("random" in got[i] for i in range(len(planted), len(got))) <= 5
