from __future__ import annotations

import math
import random
import re
import string
import time
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from lupafiscal.llm import secret_scan
from tests.llm import cases

NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]
ANY_CASE = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in n) for n in NAMES)
ASSIGN = re.compile(rf"(?:{ANY_CASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def rows():
    rng = random.Random(11)
    pieces = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "AKIA", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "é", "😀", "\n", "x.y=z", "\u017fecret", "feed" * 7]
    out = list(enumerate(cases.odd_texts()))
    out += [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for i in range(300)]
    out += [(500, "token=" + "a1" * 3000 + " é token='secret99'"), (501, cases.prose(1, 30_000)), (None, "secret: hunter22"), (502, "token = token: abcdefgh"), (502, "token = token: abcdefgh")]
    out += [(600, " ".join(f"token=secret{i:04}" for i in range(300)))]
    return out


def test_patterns_and_places(spark):
    found = secret_scan.scan(cases.documents(spark, rows()), keep=("doc_id", "text", "kept"))
    got = found.select("text", "base", secret_scan.written_spans(F.col("base")).alias("line")).collect()
    assert len(got) == len(rows())
    for r in got:
        assert sorted((s.start, s.kind, s.end) for s in r.base) == base(r.text)
        assert r.line == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base(r.text))


def random_strings(seed, n):
    rng = random.Random(seed)
    kinds = [string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_uppercase + string.digits]
    return ["".join(rng.choice(kinds[i % 3]) for _ in range(rng.randrange(20, 44))) for i in range(n)]


def ordinary_strings(seed, n):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti", "hi", "as", "to", "it"]
    return ["_".join("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 6))) for _ in range(4)) for _ in range(n)]


def test_held_out_accuracy_and_spans(spark):
    train = [(i, f"token={r} {' '.join(ordinary_strings(i, 8)).replace('_', ' ')}") for i, r in enumerate(random_strings(1, 400))]
    held = [(1000 + i, f"see {s} here") for i, s in enumerate(random_strings(2, 200))]
    plain = [(2000 + i, f"see {s} here") for i, s in enumerate(ordinary_strings(90_001, 200))]
    found = {r.doc_id: r for r in secret_scan.scan(cases.documents(spark, train + held + plain), keep=("doc_id", "text")).collect()}
    caught = [d for d, _ in held if found[d].added or found[d].base]
    assert len(caught) >= 190
    assert sum(bool(found[d].added) for d, _ in plain) <= 2
    for r in found.values():
        for s in r.added:
            assert r.text[s.start : s.end] == s.value


def test_letters_alone_and_shorter_strings_are_judged(spark):
    rng = random.Random(12)
    draw = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
    train = [(i, f"token={r} {' '.join(ordinary_strings(i, 8)).replace('_', ' ')}") for i, r in enumerate(random_strings(1, 400))]
    letters = [(1000 + i, f"see {draw(string.ascii_letters, 20, 44)} here") for i in range(100)]
    short = [(2000 + i, f"see {draw(string.ascii_letters + string.digits, 16, 20)} here") for i in range(100)]
    plain = [(3000 + i, f"see {s.replace('_', '')} here") for i, s in enumerate(ordinary_strings(90_001, 200))]
    plain += [(4000, "-" * 30 + "ab" + "-" * 30), (4001, "_" * 40), (4002, "4871316720949013")]
    found = {r.doc_id: r.added for r in secret_scan.scan(cases.documents(spark, train + letters + short + plain), keep=("doc_id",)).collect()}
    for own in (letters, short):
        assert sum(bool(found[d]) for d, _ in own) >= 90
    assert sum(bool(found[d]) for d, _ in plain) <= 2
    assert not found[4000] and not found[4001] and not found[4002]


def test_digits_alone_and_base_spans_are_not_added(spark):
    rows = [(1, "1234567890123456789012345"), (2, "token=Zx81Kq0PzLm37TgYw2Rb")]
    assert all(not r.added for r in secret_scan.scan(cases.documents(spark, rows)).collect())


def test_empty_table(spark):
    assert secret_scan.scan(cases.documents(spark, [])).count() == 0


def labelled_documents():
    return [(i, f"token={r} {' '.join(ordinary_strings(i, 8)).replace('_', ' ')}") for i, r in enumerate(random_strings(1, 400))]


# Ordinary strings with every joining character, a name in camel case, and identifiers.
JOINED = [
    "ther-on-andre-in-ofor-hias-2024", "ther/enes/of/inhised/attohe", "/andher/thisen/hatoro/innder3/tohias",
    "therOnAndreInOfOrHias", "thor_ended_intoher_hitstori", "hand-1234-add-enter-his-andation", "onen-of/ther_inhas-tohened",
    "123e4567-e89b-12d3-a456-426614174000", "123E4567-E89B-12D3-A456-426614174000",
]


def test_slugs_paths_and_identifiers_are_not_added(spark):
    rng = random.Random(21)
    alphabet = string.ascii_letters + string.digits + "+/"
    held = [(3000 + i, f"key {''.join(rng.choice(alphabet) for _ in range(40))} end") for i in range(100)]
    plain = [(2000 + i, f"see {s} here") for i, s in enumerate(JOINED)]
    plain += [(2100 + i, f"see {s.replace('_', rng.choice('-/_+'))} here") for i, s in enumerate(ordinary_strings(90_001, 100))]
    found = {r.doc_id: r.added for r in secret_scan.scan(cases.documents(spark, labelled_documents() + held + plain), keep=("doc_id",)).collect()}
    assert [s for d, s in plain if found[d]] == []
    assert sum(bool(found[d]) for d, _ in held) >= 95


def test_no_verdict_without_strings_to_train_on(spark):
    judged = [(1, "Hippopotomonstrosesquippedaliophobia"), (2, "how-to-fix-broken-build-pipelines-in-2024")]
    unlabelled = judged + [(3, "only ordinary words about many things " * 20)]
    unworded = judged + [(4, "token=Zx81Kq0PzLm37TgYw2Rb")]
    for own in (judged, unlabelled, unworded):
        assert all(not r.added for r in secret_scan.scan(cases.documents(spark, own)).collect())


def modelled(texts):
    """Ratios of steps, and the threshold, in plain Python."""
    def counts(strings):
        trained, held = Counter(), Counter()
        for s in strings:
            into = held if xxhash.xxh64(s.encode(), seed=42).intdigest() % secret_scan.HELD_OUT == 0 else trained
            into.update(p for p in zip(s, s[1:]) if p[0] in secret_scan.ALPHABET and p[1] in secret_scan.ALPHABET)
        return trained, held or trained

    labelled, words = [], []
    for text in texts:
        text = text or ""
        for start, kind, end in base(text):
            labelled.append(ASSIGN.match(text, start)[1] if kind == 0 else text[start:end])
        rest = re.sub(f"{ASSIGN.pattern}|AKIA[A-Z0-9]{{16,}}|[0-9a-f]{{24,}}|[A-Za-z0-9+/_-]{{16,}}", " ", text)
        words += re.findall("[A-Za-z0-9]{2,}", rest)
    (random_steps, random_held), (plain_steps, plain_held) = counts(labelled), counts(words)
    letters = secret_scan.ALPHABET

    def log(trained, a, b):
        line = sum(trained[a, x] + secret_scan.SMOOTHING / len(letters) for x in letters)
        share = (trained[a, b] + secret_scan.SMOOTHING / len(letters)) / line
        return math.log((1 - secret_scan.UNIFORM) * share + secret_scan.UNIFORM / len(letters))

    ratio = {(a, b): log(random_steps, a, b) - log(plain_steps, a, b) for a in letters for b in letters}
    mean = lambda held: sum(n * ratio[p] for p, n in held.items()) / sum(held.values())
    high, low = mean(random_held), mean(plain_held)
    held = [s for s in labelled if len(s) >= 16 and xxhash.xxh64(s.encode(), seed=42).intdigest() % secret_scan.HELD_OUT == 0]
    scores = sorted(math.floor(100 * average) for average in (scored(s, ratio) for s in held) if average is not None)
    spread = math.sqrt(sum(n * (ratio[p] - high) ** 2 for p, n in random_held.items()) / sum(random_held.values()))
    reached = scores[math.floor(len(scores) * secret_scan.MISSED)] / 100
    return ratio, max((high + low) / 2, min(high - secret_scan.ERRORS * spread / math.sqrt(15), reached))


def scored(s, ratio):
    steps = [ratio[p] for p in zip(s, s[1:]) if p in ratio]
    return sum(steps) / len(steps) if steps else None


def added(text, ratio, threshold):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text or ""):
        letters = sum(c.isascii() and c.isalpha() for c in m[0])
        score = scored(m[0], ratio)
        if any(a < m.end() and m.start() < b for a, _, b in base(text)) or re.match(secret_scan.UUID, m[0]):
            continue
        if (letters >= 16 or letters and re.search("[0-9]", m[0])) and score is not None and score >= threshold:
            out.append((m.start(), m.end()))
    return out


def test_added_spans_equal_plain_python(spark):
    rng = random.Random(33)
    pieces = [*random_strings(5, 30), *ordinary_strings(6, 30), *JOINED, "token=", "password: ", " ", "\n", ".", "é", "-", "/", "+", "AKIA" + "Q7" * 9, "feed" * 7, "9" * 20]
    mixed = [(5000 + i, "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(25)))) for i in range(200)]
    everything = [(None, t) for t in cases.odd_texts()] + rows() + labelled_documents() + mixed + mixed[:3]
    ratio, threshold = modelled([t for _, t in everything])
    got = secret_scan.scan(cases.documents(spark, everything), keep=("text",)).collect()
    assert len(got) == len(everything)
    assert sum(len(r.added) for r in got) > 100
    for r in got:
        assert [(s.start, s.end) for s in r.added] == added(r.text, ratio, threshold)


def test_a_text_of_very_many_matches(spark):
    rng = random.Random(8)
    keys = [rng.choice(["", "token="]) + "".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(20_000)]
    text = " ".join(keys)
    began = time.monotonic()
    [r] = secret_scan.scan(cases.documents(spark, [(1, text)]), keep=("text",)).collect()
    assert time.monotonic() - began < 40
    assert sorted((s.start, s.kind, s.end) for s in r.base) == base(text)


def test_ordinary_words_of_all_documents_are_counted(spark, monkeypatch):
    rows = [(i, f"{cases.prose(i, 5)} Name{i}") for i in range(2100)]
    rows += [(7, f"often repeated words{i % 10}") for i in range(1000)] + [(None, "without number"), (9, "token=Zx81Kq0PzLm37Tg then"), (None, None)]
    seen = Counter()

    def ratios(random, ordinary):
        for r in ordinary.collect():
            seen[r.a, r.b] += r.n

    monkeypatch.setattr(secret_scan, "ratios", ratios)
    secret_scan.scan(cases.documents(spark, rows))
    want = Counter()
    for _, text in rows:
        for word in re.findall(secret_scan.WORD, ASSIGN.sub(" ", text or "")):
            codes = [secret_scan.ALPHABET.find(c) + 1 for c in word]
            want.update(zip(codes, codes[1:]))
    assert seen == want
