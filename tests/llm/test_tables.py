"""Neighbours, WARC archives, URL filters, and the pipeline as a whole."""

import gzip
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkfold.llm import ann, langid, queries, secrets, urlrules, warc
from inkfold.llm.common import written
from tests.llm.conftest import SF


# ---- neighbours


def brute_nearest(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, x in good:
        if q % 20 == 0:
            own = sorted((-np.cumsum(x * y)[-1], i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"query_block": 3, "candidate_block": 40}])
def test_nearest(spark, blocks):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert sorted(map(tuple, ann.nearest(frame, F.col("vec_id") % 20 == 0, **blocks).collect())) == brute_nearest(rows)


def test_nearest_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(60, None), (80, []), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 2.0]), (63, [1.0, float("nan"), 1.0]), (64, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(100, [1.0, 2.0]), (101, [3.0, 1.0]), (102, rows[5][1]), (103, rows[5][1]), (120, [1e-310, 0.0, 0.0]), (140, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, r int, dim string")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert sorted(map(tuple, ann.nearest(frame, F.col("vec_id") % 20 == 0).collect())) == brute_nearest(rows)
    assert ann.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(20, 70)), rng.normal(size=(30, 70)) * 100
    (qa, sa, na, ea), (qb, sb, _, eb) = ann.quantise(a), ann.quantise(b)
    off = np.abs(ann.product(qa, qb) * sa[:, None] * sb - a @ b.T)
    assert (off <= na[:, None] * eb + ea[:, None] * np.linalg.norm(b, axis=1) + 1e-9).all()


# ---- WARC


def page_rows():
    long = "<p>" + "x" * 200 + "</p>"
    return [
        (5, "http://a/", long, "c"), (3, "http://b/é\r\nX: y", long, "c"), (9, None, long, "c"), (None, "http://n/", long, "c"), (1, "u", None, "c"), (2, "u", "", "c"), (4, "u", "short", "c"),
        (6, "u", "short", "c"), (7, "u", "é" * 60, "c"), (8, "u", "é" * 60, "c"), (8, "u", "é" * 60, "c"), (10, "u", "unique" * 40, "c"),
    ]


def test_warc_round_trip(spark, tmp_path):
    frame = spark.createDataFrame(page_rows(), "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/archives"
    warc.write(warc.records(frame), path)
    first, wanted = {}, []
    for i, _, html, _ in page_rows():
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for i, _, html, _ in page_rows():
        data = (html or "").encode()
        again = len(data) >= 100 and first[html] != i
        wanted.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in warc.inventory(spark, path).collect()))) == sorted(map(str, wanted))
    assert sorted({p.name.split("-")[0] for p in (tmp_path / "archives").iterdir() if not p.name.startswith(".")}) == ["manifest", "part"]
    payloads = {r["page_id"]: r["payload"] for r in warc.read(spark, path).where("page_id > 4 and record_type = 'response'").collect()}
    assert bytes(payloads[10]) == b"unique" * 40 and 3 not in payloads
    heads = warc.read(spark, path, "page_id long, target_uri string")
    assert {r["target_uri"] for r in heads.where("page_id in (3, 9)").collect()} == {"http://b/é%0D%0AX: y", None}


def test_warc_filters_are_pushed(spark, tmp_path):
    frame = spark.createDataFrame(page_rows(), "page_id long, url string, html string, payload string")
    warc.write(warc.records(frame), f"file://{tmp_path}/w")
    reader = warc._Reader(f"file://{tmp_path}/w", warc.read(spark, f"file://{tmp_path}/w", "page_id long, record_type string").schema, 4)
    from pyspark.sql.datasource import EqualTo, StringContains

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("target_uri",), "a")]))
    assert [type(f) for f in left] == [StringContains]
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert found and {r["record_type"] for r in found} == {"revisit"}


STANDARD = [
    ("warcinfo", "application/warc-fields", b"software: hand\r\n", []),
    ("request", "application/http;msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", ["WARC-Target-URI: http://a/"]),
    ("response", "application/http;msgtype=response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\nWARC/1.0 more", ["WARC-Target-URI: http://a/", "WARC-Payload-Digest: sha1:ABC"]),
    ("resource", "text/plain", b"plain\r\n\r\ntext", ["WARC-Target-URI: http://b/"]),
    ("revisit", "application/http;msgtype=response", b"HTTP/1.1 304 Not\r\n\r\n", ["WARC-Refers-To: <urn:uuid:2>", "WARC-Target-URI: http://a/"]),
    ("response", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 4000, ["warc-target-uri:http://c/"]),
    ("metadata", "application/warc-fields", b"", []),
]


def standard_records():
    for i, (kind, content, block, more) in enumerate(STANDARD):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{i}>", "WARC-Date: 2020-01-02T03:04:05Z", *more, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
        yield "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("kind", ["plain", "members", "one member"])
def test_standard_archives(spark, tmp_path, kind):
    """Hand-written records by the format's definition, as other software writes them."""
    records = list(standard_records())
    data = b"".join(records) if kind == "plain" else b"".join(map(gzip.compress, records)) if kind == "members" else gzip.compress(b"".join(records))
    (tmp_path / f"a.warc{'' if kind == 'plain' else '.gz'}").write_bytes(data)
    rows = warc.read(spark, f"file://{tmp_path}", f"{warc.RECORD}, {warc.HEADERS}").collect()
    body = lambda b: b.split(b"\r\n\r\n", 1)[1]
    payload = {0: STANDARD[0][2], 1: b"", 2: body(STANDARD[2][2]), 3: STANDARD[3][2], 4: None, 5: body(STANDARD[5][2]), 6: b""}
    assert [(r["record_id"], r["record_type"], r["payload"] if r["payload"] is None else bytes(r["payload"]), r["block_length"]) for r in rows] == [
        (f"urn:uuid:{i}", x[0], payload[i], len(x[2])) for i, x in enumerate(STANDARD)
    ]
    assert [r["target_uri"] for r in rows] == [None, "http://a/", "http://a/", "http://b/", "http://a/", "http://c/", None] and rows[4]["refers_to_id"] == "urn:uuid:2"
    assert {r["page_id"] for r in rows} == {None} and rows[2]["payload_digest"] == "sha1:ABC" and rows[5]["payload_length"] == 256 * 4000
    heads = warc.read(spark, f"file://{tmp_path}", "record_type string, date string, target_uri string")
    assert [tuple(r) for r in heads.where("record_type = 'response' and target_uri > 'http://b'").collect()] == [("response", "2020-01-02T03:04:05Z", "http://c/")]
    short = tmp_path / "short"
    short.mkdir()
    (short / "b.warc").write_bytes(records[2][:-20])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, f"file://{short}").collect()


def test_warc_manifests(spark, tmp_path):
    """Only files of a manifest count; overwriting replaces manifests in one step; other software's files count always."""
    frame = spark.createDataFrame(page_rows(), "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/m"
    warc.write(warc.records(frame), path)
    warc.write(warc.records(frame.where("page_id = 4")), path)
    assert warc.read(spark, path).count() == len(page_rows()) + 1
    mine = next(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part-"))
    (tmp_path / "m" / f"part-{'0' * 12}-{'1' * 32}.warc.gz").write_bytes(mine.read_bytes())  # of a task that was lost
    (tmp_path / "m" / "foreign.warc").write_bytes(next(standard_records()))
    assert warc.read(spark, path).count() == len(page_rows()) + 2
    warc.records(frame.where("page_id in (1, 2)")).write.format("warc").mode("overwrite").save(path)
    assert sorted(str(r["page_id"]) for r in warc.read(spark, path).collect()) == ["1", "2", "None"]


def test_warc_partitions_by_bytes(tmp_path, monkeypatch):
    for i in range(150):
        (tmp_path / f"{i:03}.warc").write_bytes(b"x" * 1000)
    from pyspark.sql.types import StringType, StructField, StructType

    reader = warc._Reader(f"file://{tmp_path}", StructType([StructField("record_type", StringType())]), 8)
    planned = lambda: [len(p.value) for p in reader.partitions()]
    monkeypatch.setattr(warc, "OPEN_BYTES", 0)
    assert sum(planned()) == 150 and 32 <= len(planned()) <= 40
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    assert planned() == [2] * 75


def test_warc_of_common_payloads(spark, tmp_path, monkeypatch):
    """One payload of most pages, and payloads in pairs, without any broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, "u", "<p>common</p>" * 20 if i % 3 else f"<p>{i // 2}</p>" * 30) for i in range(3000)]
        frame = spark.createDataFrame(rows, "page_id long, url string, html string")
        warc.write(warc.records(frame), f"file://{tmp_path}/c")
        first = {}
        for i, _, h in rows:
            first.setdefault(h, i)
        found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.inventory(spark, f"file://{tmp_path}/c").collect()}
        assert found == {i: ("response", None, len(h)) if first[h] == i else ("revisit", first[h], len(h)) for i, _, h in rows}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_warc_empty(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.records(frame), f"file://{tmp_path}/e")
    assert warc.inventory(spark, f"file://{tmp_path}/e").collect() == []


# ---- URLs


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def listed(host, path):
    fits = [(v, h + p) for v, h, p in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[1]), default=(None, None))


def test_url_rules(spark):
    odd = ["http://NET/x", "http://a.net", "https://www.Example.NET/en/1?q#f", "http://example.net/en", "http://badexample.com/de/", "http://example.com/de/x://y", "x", "", None, "http://org/fr/é",
           "://example.org/fr/", "http://example.net?en/", "ftp://A.b.ORG/fr/#x", "http://net/"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(1000 + i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rows = urlrules.judge(pages.withColumn("rule", F.lit("clash"))).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split_url(urls[r["page_id"]])
        verdict, rule = listed(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    assert urlrules.judge(pages.where("false")).collect() == []


def url_tokens(url):
    """Host labels, path segments and query keys with their places, digits as one mark; in order, distinct."""
    host, path = split_url(url)
    tail = url.split("://", 1)[1][len(host) :] if url and "://" in url else ""
    query = re.match(r"[^?#]*\?([^#]*)", tail)
    plain = lambda x: re.sub(r"[0-9]+", "#", x)
    out = [f"h:{plain(x)}" for x in host.split(".") if x] + [f"p:{plain(x)}" for x in path.split("/") if x]
    return list(dict.fromkeys(out + [f"q:{plain(k)}" for k in (x.split("=")[0] for x in (query[1].split("&") if query else [])) if k]))


def brute_verdicts(urls, most=3):
    """(verdict, mined tokens, confidence) of each URL, by counting every combination of tokens."""
    own, given = [url_tokens(u) for u in urls], [listed(*split_url(u))[0] for u in urls]
    every, with_label, total = Counter(), Counter(), 0
    for tokens, verdict in zip(own, given, strict=True):
        if verdict and tokens:
            total += 1
            for k in range(1, most + 1):
                for c in itertools.combinations(sorted(tokens), k):
                    every[c] += 1
                    with_label[c, verdict] += 1
    need = max(urlrules.LEAST_ROWS, math.ceil(urlrules.MIN_SUPPORT * total))
    rules = {(c, v): (n / every[c], n / total) for (c, v), n in with_label.items() if n >= need and n / every[c] >= urlrules.MIN_CONFIDENCE}
    rules = {r: x for r, x in rules.items() if not any((d, r[1]) in rules and rules[d, r[1]][0] >= x[0] for k in range(1, len(r[0])) for d in itertools.combinations(r[0], k))}
    order = sorted(rules, key=lambda r: (-rules[r][0], -rules[r][1], r))
    out = []
    for tokens, verdict in zip(own, given, strict=True):
        hit = next((r for r in order if set(r[0]) <= set(tokens)), None) if not verdict else None
        out.append((verdict or (hit[1] if hit else "allow"), " ".join(hit[0]) if hit else None, rules[hit][0] if hit else None))
    return out


def check_urls(spark, urls, **options):
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["verdict"], r["mined"], r["confidence"]) for r in urlrules.judge(frame, **options).collect()}
    assert found == dict(enumerate(brute_verdicts(urls)))
    return list(found.values())


def test_mined_verdicts_of_the_pages(spark):
    """Every verdict of the test table, by brute force; mined rules decide URLs that no listed rule fits."""
    urls = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    found = check_urls(spark, [*urls, *urls[:50], None, "", "x", "http://"])
    mined = [v for v, tokens, _ in found if tokens]
    assert len(mined) >= 50 and {"allow", "block"} == set(mined)


def test_mined_rules_of_wide_urls(spark):
    """Thirty shared query keys: every combination of up to three tokens is counted, in groups, and no more."""
    rng = random.Random(6)
    keys = [f"k{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30)]
    urls = [f"http://a{i}.example.{rng.choice(['net', 'net', 'info'])}/p/{i}?" + "&".join(f"{k}=1" for k in keys if rng.random() < 0.95) for i in range(60)]
    urls += [f"http://b.example.org/fr/x?{keys[0]}=1&{keys[7]}=2" for _ in range(8)] + [f"http://c{i}.example.info/fr/?{keys[0]}&{keys[7]}" for i in range(3)]
    check_urls(spark, urls)


def test_rare_rows_make_no_rule(spark):
    rows = [f"http://a{chr(97 + i)}.example.net/rare/" for i in range(4)] + ["http://z.example.info/rare/"]
    assert check_urls(spark, rows)[-1] == ("allow", None, None)
    assert check_urls(spark, [*rows, "http://ay.example.net/rare/"])[4][:2] == ("block", "h:example")


def test_mining_counts_all_rows_of_a_frequent_url(spark):
    one = F.col("id") % 3 == 0
    rows = spark.range(240_000).select(
        F.array(F.when(one, "h:one").otherwise("h:two")).alias("tokens"), F.when(~one, "allow").when(F.col("id") % 60 != 0, "block").otherwise("allow").alias("verdict")
    )
    assert [(own, label, pytest.approx(sure), pytest.approx(share)) for own, label, sure, share in urlrules.mine(rows)] == [(("h:two",), "allow", 1.0, 2 / 3), (("h:one",), "block", 0.95, 0.95 / 3)]


def test_matcher_is_subset_test():
    rules = [(("a", "b"), "block", 1.0, 0.5), (("c",), "block", 0.95, 0.1)]
    m = urlrules.Matcher(rules)
    assert [m(t) for t in (["a"], ["a", "b"], ["c", "a"], [], None, ["b", "c", "a"])] == [None, 0, 1, None, None, 0]


# ---- pipeline


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    """All four stages on the test table with planted rows: full Viterbi, all pairs, plain loops over characters, the tokenizer's own library."""
    from tests.llm.test_dedup import brute
    from tests.llm.test_scans import base, brute_random

    rng = random.Random(4)
    rows = [tuple(r) for r in docs.collect()]
    by = {r[2]: r[1][:600] for r in rows if r[2] and len(r[1] or "") > 900}
    token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    own = " ".join(rng.choice(by["en"].split()) for _ in range(60))
    rows += [(90_001, "\n".join(by.values()), None, "s", 1), (90_002, f"{own} {token}", "en", "s", 2), (90_003, f"{own} {token} end", "en", "s", 3), (90_004, "123 !", "en", "s", 4), (90_005, None, None, None, None)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fit(frame.where(~langid.is_held_out("doc_id")))

    def clear(text):
        words = [m[0] for m in langid.WORD.finditer(text or "")]
        if not any(c.isalpha() for c in text or ""):
            return False
        path = langid.viterbi(np.concatenate([model.word_scores([w]) for w in words]), model.penalty)
        letters = Counter()
        for w, k in zip(words, path.tolist(), strict=True):
            letters[k] += len(w)
        return max(letters.values()) > 0.5 * sum(letters.values())

    kept = {r[0]: r[1] for r in rows if clear(r[1])}
    single = {i for i, _, c in brute(list(kept.items()), 5) if i == c}
    texts = {i: kept[i] for i in single}
    spans = {i: [(s, e) for s, _, e in base(t)] for i, t in texts.items()}
    for i, s, e in brute_random(texts):
        spans[i].append((s, e))
    assert 90_001 not in kept and 90_002 in single and 90_003 not in single and any(texts[90_002][s:e] == token for s, e in spans[90_002])
    library, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == single
    for i, text in texts.items():
        covered, masked = {x for s, e in spans[i] for x in range(s, e)}, []
        for x, c in enumerate(text):
            if x not in covered:
                masked.append(c)
            elif x - 1 not in covered or any(s == x and not any(s < x < e for s, e in spans[i]) for s, _ in spans[i]):
                masked.append("[secret]")
        ids = [*library.encode("".join(masked), add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    filled = {}
    for r in found:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


CLASHES = {"score": 7.0, "spans": "own", "lang_pred": "own", "node": 1, "rep": 2, "_sieve_p": 3, "_group_stay": "own", "_found": "own", "a.b": 4}


def test_all_stages_and_operators_with_clashing_columns(spark, docs):
    """Columns named like the operators' own come through every stage unchanged, and change no operator's result."""
    from inkfold.llm import bpe, dedup, licenses, media, packing

    frame = docs.limit(80).withColumns({n: F.lit(v) for n, v in CLASHES.items()})
    kinds = dict(frame.dtypes)
    out = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == frame.columns and dict(out.dtypes) == kinds
        out = written(out, "clashing")
    rows = out.collect()
    assert rows and all({n: r[n] for n in CLASHES} == CLASHES for r in rows)
    plain, model = frame.select(docs.columns), langid.fit(docs)
    json, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    for run in (
        lambda f: licenses.digest(licenses.scan(f)), lambda f: bpe.round_trip(f, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern), lambda f: media.inspect(media.to_media(f)),
        lambda f: langid.identify(f, model, keep=["doc_id"]), lambda f: dedup.near_duplicates(f, ngram=4), lambda f: secrets.digest(secrets.find_secrets(f)),
        lambda f: packing.pack(f, json, pattern).groupBy("doc_id").agg(F.sum("length").alias("n")),
    ):
        assert sorted(map(str, run(frame).collect())) == sorted(map(str, run(plain).collect()))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    clashing = pages.withColumns({n: F.lit(v) for n, v in (CLASHES | dict.fromkeys(["rule", "verdict", "tokens", "payload", "salt", "first"], "own")).items()})
    assert sorted(map(str, urlrules.judge(clashing).collect())) == sorted(map(str, urlrules.judge(pages).collect()))
    assert sorted(map(str, warc.records(clashing).drop("payload").collect())) == sorted(map(str, warc.records(pages).drop("payload").collect()))
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    near = lambda f: sorted(map(str, ann.nearest(f, F.col("vec_id") % 20 == 0).collect()))
    assert near(vectors.withColumns({n: F.lit(v) for n, v in (CLASHES | {"rank": 1}).items()})) == near(vectors)


def test_stages_keep_columns(spark, odd_docs, no_docs):
    for frame in (odd_docs, no_docs):
        out = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == frame.columns and out.dtypes == frame.dtypes
        corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
