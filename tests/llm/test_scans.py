import hashlib
import io
import itertools
import math
import random
import re
import string
import struct
import time
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkfold.llm import licenses, media, secrets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- licences


def places(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return words, sorted(found)


def test_licence_places(docs, odd_docs, no_docs):
    for frame in (docs, odd_docs, no_docs):
        texts = {}
        for r in frame.collect():
            texts.setdefault(r["doc_id"], []).append(r["text"])
        rows = licenses.digest(licenses.scan(frame)).collect()
        assert len(rows) == sum(map(len, texts.values()))
        for r in rows:
            wanted = []
            for text in texts[r["doc_id"]]:
                words, found = places(text)
                starts = [i for i, _ in found]
                wanted.append((len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in wanted
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def brute_labels(text):
    """Labels and score by trying every place for every template and every word of it."""
    words = WORD.findall((text or "").translate(LOWER))
    split = lambda x: WORD.findall(x.translate(LOWER))
    every = [split(body) for _, body, _ in licenses.TEMPLATES] + [split(p) for p, _ in licenses.BASE]
    weight = lambda w: math.log(1 + len(every) / sum(w in body for body in every))
    labels, best = set(), 0.0
    for (label, _, key), body in zip(licenses.TEMPLATES, every, strict=False):
        key = split(key)
        at = next(i for i in range(len(body)) if body[i : i + len(key)] == key)
        for s in range(len(words) - len(key) + 1):
            if words[s : s + len(key)] == key:
                hit = [w in words[max(0, s - at + p - licenses.DRIFT) : max(0, s - at + p + licenses.DRIFT + 1)] for p, w in enumerate(body)]
                share = sum(weight(w) for w, h in zip(body, hit, strict=True) if h) / sum(map(weight, body))
                if share >= licenses.LEAST:
                    labels.add(label)
                    best = max(best, min(1.0, share))
    for phrase, label in licenses.BASE:
        if any(words[s : s + len(split(phrase))] == split(phrase) for s in range(len(words))):
            labels.add(label)
            best = 1.0
    return sorted(labels), best


def licence_texts():
    """Templates whole, cut, with words put in, changed or left out, and beside each other."""
    rng = random.Random(2)
    out = ["SPDX-License-Identifier: GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "the mit license the mit license", "cc by nc cc by nc"]
    for label, body, _ in licenses.TEMPLATES:
        words = body.split()
        out += [f"Copyright 2020 Foo. {body} The end", " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 3 :])]
        for chance in (0.03, 0.15, 0.4):
            changed = [x for w in words for x in ([w] if rng.random() > chance else rng.choice([[], ["really"], [w, "very", "much"]]))]
            out.append(f"{label} " + " ".join(changed))
    return out + [f"{rng.choice(out)} {rng.choice(out)}" for _ in range(40)]


def test_licence_labels_against_brute_force(docs):
    index = licenses.Index()
    for text in [*licence_texts(), *(r["text"] for r in docs.collect())]:
        _, labels, score = index.find(licenses.words_of(text))
        wanted = brute_labels(text)
        assert (labels, pytest.approx(score)) == wanted, text


def test_licences_by_hand():
    index = licenses.Index()
    labels = lambda text: index.find(licenses.words_of(text))[1]
    for label, body, _ in licenses.TEMPLATES:
        assert label in labels("Foo bar. " + body.title() + "! baz")
    assert labels(licenses._MIT.replace("this software", "this really very software", 1).replace("to deal", "so as to deal")) == []  # the key phrase itself is broken
    assert labels(licenses._MIT.replace("to deal", "so as to really deal").replace("THE AUTHORS", "THE KIND AUTHORS OF THIS")) == ["mit"]
    assert labels("# SPDX-License-Identifier: MIT") == ["mit"] and labels("SPDX-License-Identifier: GPL-3.0-or-later") == ["gpl-3"]
    assert labels(licenses._GPL.format(kind="", n=3)) == ["gpl-3"] and labels("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007") == ["gpl-3"]
    assert labels(f"{licenses._BSD_2} {licenses._BSD_END}") == ["bsd-2"]
    assert labels("the general public met under a license") == []
    assert labels("free of charge, to any person obtaining a copy of this software and associated documentation files") == []  # the phrase alone is too little of it
    assert [w for w, _ in index.find(licenses.words_of("cc by nc cc by nc"))[0]] == [0, 3]


# ---- secrets


def base(text):
    out = []
    text = text or ""
    word = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out += [(m.start(), 0, m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def text_of(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans(docs, odd_docs, no_docs):
    for frame in (docs, odd_docs, no_docs):
        texts = {}
        for r in frame.collect():
            texts.setdefault(r["doc_id"], []).append(r["text"])
        rows = secrets.digest(secrets.find_secrets(frame)).collect()
        assert len(rows) == sum(map(len, texts.values()))
        for r in rows:
            wanted = [base(t) for t in texts[r["doc_id"]]]
            assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) in [(*(sum(k == i for _, k, _ in w) for i in range(3)), hashlib.sha256(text_of(w).encode()).hexdigest()) for w in wanted]
            assert any(set(filter(None, text_of(w).split(","))) <= set(r["spans"].split(",")) for w in wanted)


def test_battery_tells_random_from_regular():
    token = hashlib.sha256(b"x").hexdigest() + hashlib.sha256(b"y").hexdigest()
    assert secrets.p_random(token, "0123456789abcdef") > 0.01
    assert secrets.p_random("0123456789abcdef" * 4, "0123456789abcdef") < 1e-6
    assert secrets.p_random("a1" * 30, secrets.ENCODINGS[3][1]) < 1e-6
    rng = random.Random(5)
    for _, alphabet in secrets.ALPHABETS:
        for n in (20, 24, 32, 40, 100):
            failed = sum(secrets.p_random("".join(rng.choices(alphabet, k=n)), alphabet) < secrets.BATTERY for _ in range(1000))
            assert failed <= 20, (alphabet, n, failed)


def test_false_discovery_cut():
    histogram = [(1, 0, 90), (1, 200, 10)]  # ten tokens with p = 1e-10
    assert secrets.cuts(histogram)[1] == 200
    assert secrets.cuts([(1, 0, 100)])[1] > secrets.DEEPEST * secrets.STEPS
    assert secrets.cuts([(1, 26, 1), (1, 0, 99)])[1] > 26  # p = 0.05 is too much for one of a hundred


def key(rng, n, alphabet):
    return "".join(rng.choices(alphabet, k=n))


BASE62 = string.ascii_letters + string.digits
ORDINARY = [
    "chapter1_section2_figure3", "getHttpResponseHeaderValue", "internationalization", "Verantwortlichkeiten", "state-of-the-art-way", "/usr/local/share/documents", "MyLongIdentifierNames",
    "https/www/example/com/index", "test_case_number_0001", "aaaaaaaaaaaaaaaaaaaaaaaa", "--------------------", "01234567890123456789", "abcdefghijklmnopqrstuvwxyz", "2024-01-01-2025-12-31",
    "THE_QUICK_BROWN_FOX_JUMPS", "ababababababababababab", "foo/bar/baz/foo/bar/baz", "version-1-2-3-of-the-file", "section_number_twelve", "the-thing-and-the-other",
]


@pytest.fixture(scope="module")
def planted(spark, docs):
    """Texts with random keys of several alphabets and lengths, and with ordinary long tokens."""
    rng = random.Random(8)
    alphabets = [BASE62, BASE62 + "+/", BASE62 + "-_", string.ascii_uppercase + "234567", "0123456789abcdef", string.ascii_lowercase + string.digits]
    rows, keys = [(r["doc_id"], r["text"]) for r in docs.collect()], {}
    for i in range(120):
        token = key(rng, rng.choice([20, 22]) if i % 6 == 4 else rng.choice([20, 24, 32, 40, 64, 200]), alphabets[i % 6])
        text = f"the thing {ORDINARY[i % len(ORDINARY)]} and a number {token} of the other {ORDINARY[(i * 7 + 3) % len(ORDINARY)]} thing"
        keys[100_000 + i] = (text.index(token), text.index(token) + len(token))
        rows.append((100_000 + i, text))
    return spark.createDataFrame(rows, "doc_id long, text string"), keys


def test_planted_keys_are_found_and_ordinary_tokens_are_not(planted):
    frame, keys = planted
    found = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"] if x["kind"] == 3] for r in secrets.find_secrets(frame).collect()}
    reported = [(d, s) for d, own in found.items() for s in own]
    right = sum(keys.get(d) == s for d, s in reported)
    assert right >= 0.95 * len(keys) and right >= 0.95 * len(reported)


def brute_random(texts):
    """(document, start, end) of random spans: counts, chain, p-values and thresholds once more, by plain loops over characters."""
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    marks, letters, kinds = set(secrets.SYMBOLS), Counter(), Counter()
    for t in texts.values():
        for a, b in itertools.pairwise(t):
            if a in marks and b in marks:
                kinds[kind(a), kind(b)] += 1
                if a.isalpha() and b.isalpha():
                    letters[a.lower(), b.lower()] += 1
    abc = string.ascii_lowercase
    row = {a: sum(letters[a, b] + 1 / 26 for b in abc) for a in abc}
    first = {b: sum(letters[a, b] + 1 / 26 for a in abc) for b in abc}
    after = {a: sum(kinds[a, b] + 1 for b in range(4)) for a in range(4)}

    def ordinary(body):
        both = [plain(body), plain(body.lower())] if body.upper() == body != body.lower() else [plain(body)]
        return math.log(0.5) + max(both) + math.log(sum(math.exp(x - max(both)) for x in both))

    def plain(body):
        total = math.log(1 / 4)
        for i, c in enumerate(body):
            if i:
                total += math.log(0.8 * (kinds[kind(body[i - 1]), kind(c)] + 1) / after[kind(body[i - 1])] + 0.05)
            if c.isalpha():
                before = body[i - 1].lower() if i and body[i - 1].isalpha() else None
                share = (letters[before, c.lower()] + 1 / 26) / row[before] if before else first[c.lower()] / sum(first.values())
                total += math.log(0.9 * share + 0.1 / 26)
            else:
                total += math.log(0.1 if c.isdigit() else 0.25)
        return total

    tests = []
    for d, t in texts.items():
        spans = base(t)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t):
            body = m[0].rstrip("=")
            alphabet = next((a for _, a in secrets.ALPHABETS if body and set(body) <= set(a)), None)
            if alphabet and not any(s < m.end() and m.start() < e for s, _, e in spans):
                ratio = 9 * math.exp(max(-690, min(0, ordinary(body) + len(body) * math.log(len(alphabet)))))
                p = 1.0 if secrets.p_random(m[0], alphabet) < 0.005 else min(1, ratio)
                tests.append((sum(len(m[0]) >= x for x in (20, 28, 40, 64, 128, 512)), min(600, math.floor(-math.log10(p) * 20 + 1e-9)), (d, m.start(), m.end())))
    wanted = set()
    for c in {x for x, _, _ in tests}:
        own = [(b, at) for x, b, at in tests if x == c]
        good = [b for b, _ in own if 10 ** (-b / 20) <= 0.05 * sum(y >= b for y, _ in own) / len(own)]
        wanted |= {at for b, at in own if good and b >= min(good)}
    return wanted


def test_random_spans_against_brute_force(planted):
    frame, _ = planted
    wanted = brute_random({r["doc_id"]: r["text"] or "" for r in frame.collect()})
    found = {(r["doc_id"], x["start"], x["end"]) for r in secrets.find_secrets(frame).collect() for x in r["spans"] if x["kind"] == 3}
    assert found == wanted and len(found) > 100


def test_many_spans_take_linear_time():
    text = " ".join(f"token=abcdef{i} {hashlib.md5(str(i).encode()).hexdigest()[:23]}" for i in range(60_000))
    began = time.monotonic()
    spans, tokens = secrets.scan(text)
    assert len(spans) == len(tokens) == 60_000 and time.monotonic() - began < 10


def test_redaction(spark):
    rows = [(1, "my password=abc12345 is here", 28), (2, "clean text", 10), (3, None, None), (4, "", 0)]
    out = {r["doc_id"]: r for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert out[1]["text"] == "my [secret] is here" and out[1]["n_chars"] == len(out[1]["text"])
    assert (out[2]["text"], out[3]["text"], out[4]["text"]) == ("clean text", None, "")


def test_redaction_masks_all_spans(planted):
    frame, keys = planted
    frame = frame.withColumn("a.b", F.lit(1)).withColumn("base", F.lit("own"))
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(frame).collect()}
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in secrets.redact(frame).collect():
        text, at = "", 0
        for x in found[r["doc_id"]]:
            if x["end"] > at:
                text += texts[r["doc_id"]][at : x["start"]] + "[secret]" if x["start"] >= at else ""
                at = x["end"]
        assert r["base"] == "own" and (r["text"] or "") == text + (texts[r["doc_id"]] or "")[at:]


# ---- media


def png() -> bytes:
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


GIF = b"GIF89a" + bytes(7) + b"\x2c" + bytes(9) + b"\x02\x02ab\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cdxyz\xff\xd9"


@pytest.mark.parametrize("data,kind", [(png(), "png"), (GIF, "gif"), (JPEG, "jpeg"), (__import__("gzip").compress(b"hello" * 50), "gzip"), (b"%PDF-1.7 x startxref 9 %%EOF", "pdf")])
def test_sniff_and_carve(data, kind):
    assert media.sniff(data) == [(kind, 0, len(data))]
    inside = b"text before " + data + b" and after"
    assert media.sniff(inside) == [(kind, 12, 12 + len(data))]
    assert media.sniff(data[:-1]) == []


def mp4(*names) -> bytes:
    return struct.pack(">I4s4sI", 20, b"ftyp", b"isom", 1) + b"mp41" + b"".join(struct.pack(">I4s", 12, n) + b"abcd" for n in names)


def stored_zip(name: bytes, data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name.decode(), data)
    return out.getvalue()


def crc(data: bytes, poly: int, bits: int) -> int:
    x = 0
    for byte in data:
        x ^= byte << bits - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> bits - 1 & 1 else 0)) & (1 << bits) - 1
    return x


def flac(samples: int, frames: list[tuple[int, bytes]]) -> bytes:
    """Frames (samples - 1 as 16 bits) of any bytes, as the format's definition frames them."""
    info = bytes(10) + ((44100 << 44) | (7 << 36) | samples).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x84\x00\x00\x03abc"
    for i, (n, body) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x70, 0, i]) + (n - 1).to_bytes(2, "big")
        frame = head + bytes([crc(head, 0x07, 8)]) + body
        out += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
    return out


def test_lengths_are_confirmed():
    """FLAC by its frames, MP4 by its boxes, ZIP by its central directory; what follows them is seen."""
    music = flac(250, [(100, b"first frame" * 9), (100, b"second" * 20), (50, b"third")])
    movie = mp4(b"moov", b"mdat")
    outer = stored_zip(b"in.zip", stored_zip(b"a", b"text " * 20))
    for data, kind in ((music, "flac"), (movie, "mp4"), (outer, "zip")):
        assert media.sniff(data)[0] == (kind, 0, len(data)) and len(media.sniff(data)) == 1 + (kind == "zip")  # files in the whole one are listed too
        assert media.sniff(b"x" * 7 + data + b"--" + GIF) == [(kind, 7, 7 + len(data)), ("gif", 9 + len(data), 9 + len(data) + len(GIF))]
        assert all(k != kind or s for k, s, _ in media.sniff(data[:-1])) or kind == "mp4"
    assert media.sniff(music[:60] + b"?" + music[61:]) == [] and media.sniff(flac(0, [(100, b"no total")])) == []
    assert media.sniff(struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 1)) == [] and media.sniff(b"a draft,ftyp of text") == []


@pytest.mark.parametrize("mark", [b"PK\x03\x04", b"%PDF-1.4 ", b"RIFF", b".snd", b"P5\n1 1\n", b"GIF89a", b"fLaC", b"xxxxftyp", b"%PDF-1.4 startxref ", b"PK\x03\x04PK\x05\x06"])
def test_many_false_hits_take_linear_time(mark):
    data = mark * (10_000_000 // len(mark))
    began = time.monotonic()
    assert [f for f in media.sniff(data) if f[0] != "pgm"] == [] and time.monotonic() - began < 40


def test_embedded_files_are_carved_whatever_the_storage(spark):
    """A PDF within texts that are stored as WAV, AU and PGM; offsets are of the stored bytes."""
    rows = [(i, f"text {i} %PDF-1.7 x startxref 9 %%EOF after") for i in range(30)]
    for r in media.inspect(media.to_media(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        (x,) = r["embedded"]
        assert x["type"] == "pdf" and x["end"] - x["start"] == len("%PDF-1.7 x startxref 9 %%EOF") and f"pdf@{x['start']}-{x['end']}" in r["feature"]
        at = {"wav": 44, "au": 24}.get(r["type"], len(f"P5\n64 {r['payload_bytes'] // 64}\n255\n"))
        assert x["start"] - at == len(f"text {r['doc_id']} ")


def test_media_round_trip(docs, odd_docs, no_docs):
    for frame in (docs, odd_docs, no_docs):
        wanted = []
        for r in frame.collect():
            data = (r["text"] or "").encode()
            payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            wanted.append((r["doc_id"], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
        rows = media.inspect(media.to_media(frame)).collect()
        assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows))) == sorted(map(str, wanted))
        assert {r["type"] for r in rows} <= set(media.STORED) and all(r["feature"].startswith(r["type"]) for r in rows)
        by_payload = {}
        for r in rows:
            assert by_payload.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
