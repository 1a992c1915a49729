"""The other operators against brute force, exact round trips and planted cases."""

import hashlib
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import binary_ids, exact_topk, language, licences, matroska, mixing, near_dups, packing, quality, queries, tokens

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (2, ""), (3, "x " * 30_000), (None, "no id"), (4, "same"), (5, "same"), (6, "é😀ß"), (7, " \n\t")]
EXTRA = "doc_id long, text string, seq int, start string, sequence_id string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    return spark.createDataFrame([(i, t, 1, "a", "b", None if i in (1, 2) else "s", None) for i, t in ODD], EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


# --- 1


def test_topk_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(307, [1e307, 1.0, 1.0, 1.0]), (300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (304, []), (None, [1.0] * 4), (305, [1.0, 1.0]), rows[7], (306, [1e12, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, score string")
    good = {i: tuple(int(np.floor(256 * x)) for x in v) for i, v in rows if i is not None and v and len(v) == 4 and all(x is not None and np.isfinite(256 * x) for x in v)}
    got = {}
    for r in exact_topk.top_k(df, df.filter("vec_id % 10 = 0"), k=3, tile_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 10 == 0}
    for q, found in got.items():
        best = sorted(((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q))[:3]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert exact_topk.top_k(df.filter("false"), df).count() == 0


# --- 2


def check_packing(rows, want, length=packing.LENGTH):
    """Every id in exactly one piece, sequences gapless and not too long."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, ids in want.items():
        got = sorted(by_doc[doc], key=lambda r: r.start)
        assert [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got])[:-1]) and sum(r.length for r in got) == len(ids)
        for r in got:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes()) and list(r.ids) == list(part)
    for pieces in by_seq.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) <= length
    return len(by_seq)


def test_packing(spark, docs, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rows = docs.collect()
    want = {r.doc_id: [*plain.encode(r.text, add_special_tokens=False).ids, 1] for r in rows}
    for window in (16, 2048):
        n = check_packing(packing.pack(docs.coalesce(1), path, window=window).collect(), want)
        assert n == -(-sum(map(len, want.values())) // packing.LENGTH)  # only the last is padded
    got = packing.pack(odd, path).collect()
    assert sum(r.length for r in got if r.doc_id == 2) == 2 and [r.length for r in got if r.doc_id == 1] == [1]
    assert packing.pack(none, path).count() == 0


def test_packing_encodes_a_batch_of_texts_together(docs, monkeypatch):
    """Chunks that the texts of a batch share are looked up once, not once for each text."""
    rows = docs.select("doc_id", "text").limit(300).collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r.doc_id for r in rows]), pa.array([r.text for r in rows])], ["doc_id", "text"])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, kind: run)  # what a task runs
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    enc = tokens.ChunkEncoder(path := public_tokenizers.path("byte_bpe_50k.json"), tokens.BYTE_CHUNKS)
    monkeypatch.setattr(tokens, "encoder", lambda *a: enc)
    calls, encode = [], enc._encode_together
    monkeypatch.setattr(enc, "_encode_together", lambda texts: calls.append(len(texts)) or encode(texts))
    out = pa.Table.from_batches(packing.pack(docs, path, with_ids=False)(iter([batch])))
    assert set(out["doc_id"].to_pylist()) == {r.doc_id for r in rows} and len([n for n in calls if n]) == 1


def test_balance_prefers_the_cheapest_sequence():
    placed = packing.balance([6, 5, 4, 1], 8, 2, 1.0, 1.0)
    assert placed == [(0, 0, 6, 0), (1, 0, 5, 1), (2, 0, 3, 1), (2, 3, 1, 0), (3, 0, 1, 0)]


# --- 3


def test_media_round_trip(spark, docs, odd, none):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_matroska"](spark, SF).collect()}
    for r in docs.collect():
        raw = r.text.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        got, media = rows[r.doc_id], matroska.mux(payload)
        assert (got.n_bytes, got.payload_bytes, got.media_bytes) == (len(raw), len(payload), len(media))
        assert got.payload_sha256 == hashlib.sha256(payload).hexdigest() and got.tail_crc32 == zlib.crc32(payload[-64:])
        assert got.media_sha256 == hashlib.sha256(media).hexdigest()
    assert matroska.read_media(matroska.text_media(odd)).count() == len(ODD) and matroska.read_media(matroska.text_media(none)).count() == 0


def test_packet_table(spark, odd):
    t = matroska.packet_table(matroska.text_media(odd.filter("doc_id = 3")))
    rows = t.orderBy("packet").collect()
    assert sum(r.n_bytes for r in rows) == 60_032 and {r.error for r in rows} == {None} and rows[1].timestamp_ms == 64.0 and {r.codec for r in rows} == {"A_PCM/INT/LIT"}
    assert rows[-1].cluster == (60_032 - 1) // (512 * 8 * 16)
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(matroska.mux(b"a" * 6400)[:-3000]))], "doc_id int, media binary")
    got = matroska.packet_table(broken).collect()
    assert {r.id: r.error is not None for r in got if r.packet is None} == {1: True, 2: True, 3: True}


def test_lacings_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 20, b"c" * 7]
    for mode in ("none", "xiph", "ebml", "fixed"):
        own = frames if mode in ("xiph", "ebml") else frames[:1] if mode == "none" else [b"x" * 9] * 3
        if mode == "xiph":
            sizes = bytes([2]) + b"\xff\x2d" + b"\x14"
            body = b"\x81\x00\x00\x82" + sizes + b"".join(own)
            block = matroska.element(matroska.SIMPLE, body)
        else:
            block = matroska.laced_block(own, 1, 0)
        cluster = matroska.element(matroska.TIME, b"\x05") + block + matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x02\x00zz") + matroska.element(matroska.REFERENCE, b"\x01"))
        data = matroska._HEAD + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
        for _ in range(2):
            data += matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster
        p = matroska.parse(data)
        assert p.error is None
        first = [data[a : a + n] for _, _, a, n, _, c in p.packets if c == 0]
        assert first == [*own, b"zz"] and len(p.packets) == 2 * len(first) and not p.packets[len(own)][4] and p.packets[len(own)][1] == 7.0
    for n in range(len(data)):
        matroska.parse(data[:n])  # whatever is cut off, no exception


# --- 4


def test_segments_round_trip():
    rng = np.random.default_rng(1)
    for n, high, top in ((0, 1, 5), (1, 1, 70_000), (500, 40, 60_000), (3, 100_000, 99), (2000, 2, 80_000)):
        ends = np.cumsum(rng.integers(0, high, n))
        ids = rng.integers(0, top, int(ends[-1]) if n else 0).astype(np.uint32)
        s = binary_ids.Segment(binary_ids.encode_segment(ends, ids))
        assert (s.ends() == ends).all() and (s.ids == ids).all() and [s.end(i) for i in range(n)] == list(ends)
        assert all((s.document(i) == ids[(ends[i - 1] if i else 0) : ends[i]]).all() for i in range(0, n, 7))


def test_binary_ids(spark, docs, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    got = sorted(queries.QUERIES["op4_binary_ids"](spark, SF).collect())
    at = 0
    for r, d in zip(got, sorted(docs.collect(), key=lambda d: d.doc_id), strict=True):
        ids = np.array([*plain.encode(d.text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = binary_ids.read_documents(binary_ids.write_segments(odd, path, segment_ids=50)).collect()
    assert len(rows) == len(ODD) and min(rows, key=lambda r: r.start).doc_id is None
    assert binary_ids.read_documents(binary_ids.write_segments(none, path)).count() == 0


# --- 5


def test_quality(spark, odd, none):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioubcdt") for _ in range(4))
    rows = []
    for i in range(900):
        words = [word() for _ in range(40)]
        if i % 3 == 0:
            words = [w.upper() + "!!" for w in words]
        elif i % 3 == 1:
            words[5], words[9] = "vileword", "nastyword"
        rows.append((i, " ".join(words), i % 3))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.fit(df.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), df.filter("doc_id < 600").select("doc_id", "grade"), grades=3)
    assert list(model.thresholds) == sorted(model.thresholds)
    new = df.filter("doc_id >= 600")
    got = quality.score(new, model, tail=2).join(new.select("doc_id", "grade"), "doc_id").collect()
    assert sum((r.tail_prob >= 0.5) == (r.grade == 2) for r in got) >= 0.97 * len(got)
    mean = [np.mean([r.expected_grade for r in got if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert quality.score(odd, model, 2).count() == len(ODD) and quality.score(none, model, 2).count() == 0
    flat = quality.fit(df, df.filter("grade = 1").select("doc_id", "grade"), grades=3)
    assert quality.score(odd, flat, 2).filter("tail_prob < 0.99").count() == 0
    clash = new.withColumn("tail_prob", F.lit("a")).withColumn("expected_grade", F.lit("b")).withColumn("row", F.lit(1))
    kept = quality.select(clash, model, tail=2, least=0.5)
    assert kept.columns == clash.columns and kept.filter("tail_prob = 'a' and expected_grade = 'b' and row = 1").count() == sum(r.tail_prob >= 0.5 for r in got)
    # scores by the plain formula
    for r in got[:20]:
        f = float(model.weights[quality.features(new.filter(F.col("doc_id") == r.doc_id).first().text)].sum())
        above = [1 / (1 + np.exp(t - f)) for t in model.thresholds]
        assert abs(r.expected_grade - sum(above)) < 1e-5 and abs(r.tail_prob - above[1]) < 1e-5


def test_quality_steps_down_the_likelihood():
    """One step of one text against the gradient by differences of the plain likelihood."""
    rng = np.random.default_rng(8)
    logistic = lambda x: 1 / (1 + np.exp(-x))
    for y in range(3):
        w, t, x = rng.normal(0, 0.3, 12), np.array([-0.4, 0.7]), np.array([1, 4, 5, 9])

        def loss(w, t, x=x, y=y):
            f = w[x].sum()
            return -np.log((logistic(t[y] - f) if y < 2 else 1) - (logistic(t[y - 1] - f) if y else 0))

        new, new_t, squares, rate = w.copy(), t.copy(), np.ones(12), 1e-3
        quality.epoch(new, squares, new_t, [(x, y, 1.0)], rate)
        for k in range(12):
            e = np.eye(12)[k] * 1e-5
            g = (loss(w + e, t) - loss(w - e, t)) / 2e-5
            assert abs((w - new)[k] - rate * g / np.sqrt(1 + g * g)) < 1e-8
        for k in range(2):
            e = np.eye(2)[k] * 1e-5
            g = (loss(w, t + e) - loss(w, t - e)) / 2e-5
            assert abs((t - new_t)[k] - rate * g / np.sqrt(1 + g * g)) < 1e-8


# --- 6


def test_language(spark, docs, odd, none):
    got = queries.QUERIES["op6_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    tables = language.fit(docs)
    texts = {x: docs.filter(F.col("lang") == x).first().text[:600] for x in ("en", "de")}
    both = spark.createDataFrame([(1, texts["en"] + " ... " + texts["de"])], "doc_id long, text string")
    spans = language.predict(both, tables).first().spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].end - 600) < 60
    out = {r.doc_id: r for r in language.predict(odd.filter("doc_id is not null"), tables).collect()}
    assert [out[i].lang_pred for i in (1, 2, 7)] == ["und"] * 3 and out[3].score > 0
    assert language.predict(none, tables).count() == 0
    long = "".join(c for c in texts["de"] if c.isalpha())  # one run of letters: more than its beginning counts
    rows = [(1, "½ ² Ⅷ"), (2, texts["en"] + " ½²"), (3, "".join(c for c in texts["en"] if c.isalpha())[:64] + long * 20), (4, "1² _")]
    out = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), tables).collect()}
    assert [(out[i].lang_pred, out[i].score) for i in (1, 4)] == [("und", 0.0)] * 2 and out[2].lang_pred == "en" and out[3].lang_pred == "de"
    assert set(language.fit(docs, most_grams=None)["grams"]) >= set(tables["grams"])
    assert {r.lang_pred for r in language.predict(odd, language.fit(odd)).collect()} == {"und"}


def test_viterbi_equals_plain_dynamic_programming():
    rng = np.random.default_rng(2)
    m = language.Model(["a", "b", "c"], {"x": [0.0] * 3}, [[0.0] * 3] * 3, {}, penalty=3.0)
    docs = []
    for n in [0, 1, 2, 5, 40, 40, 200]:
        at = len(m.known)
        m.known.update({f"{at + i}": at + i for i in range(n)})
        m.table[at : at + n] = rng.normal(0, 1.5, (n, 3)) + (np.eye(3)[rng.integers(3)] * rng.integers(0, 4))
        docs.append(np.arange(at, at + n))
    total = lambda d, path: sum(m.table[i, s] for i, s in zip(d, path)) - 3.0 * np.count_nonzero(np.diff(path))
    for d, path in zip(docs, m.viterbi(docs)):
        if not len(d):
            continue
        best = m.table[d[0]].astype(float)
        for i in d[1:]:
            best = np.maximum(best, best.max() - 3.0) + m.table[i]
        assert abs(total(d, path.astype(int)) - best.max()) < 1e-2


# --- 8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def scanned(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_licences(spark, odd, none):
    more = ["MIT License", "the MIT  \n LICENSE, cc-by cc by. Apache license gnu/general public license x", "smit license mit licenses", "cc bya cc by", "éMIT license", "MIT License " * 3000, "K mit licenSe ſ"]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(more, 100)), "doc_id long, text string"))
    for source in (df, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        texts = {r.doc_id: r.text for r in source.collect()}
        for r in licences.labelled(licences.scan(source)).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scanned(texts[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licences.labelled(licences.scan(none)).count() == 0


def test_rules_resolve_overlaps(spark):
    assert len(licences.rules()) >= 200
    texts = ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the MIT License.", "GNU Lesser General Public License v2.1", "see https://www.gnu.org/licenses/gpl-3.0.html", "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert [[d.label for d in got[i].detections] for i in range(6)] == [["cc-by-nc"], ["apache"], ["mit"], ["lgpl"], ["gpl"], []]
    assert (got[2].detections[0].start, got[2].detections[0].end, got[2].detections[0].form) == (0, 30, "grant")


def spelled(tree):
    """Texts of a parsed pattern: every alternative, optional parts with and without, the first character of a class."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            kind, first = arg[0]
            some = [" " if str(kind) == "CATEGORY" else chr(first if str(kind) == "LITERAL" else first[0])]
        elif name == "BRANCH":
            some = [x for part in arg[1] for x in spelled(part)]
        elif name == "SUBPATTERN":
            some = spelled(arg[3])
        elif name == "MAX_REPEAT":
            some = [x * n for n in sorted({arg[0], max(arg[0], 1)}) for x in spelled(arg[2])]
        else:
            assert name == "ASSERT_NOT", name
            some = [""]
        out = [a + b for a in out for b in some]
    return list(dict.fromkeys(out))


def test_no_rule_is_dead(spark):
    every = []
    for label, (_, *patterns) in licences.FAMILIES.items():
        name, spdx, url = (spelled(re._parser.parse(p.replace(licences._S, " ").replace(licences._O, " "))) for p in patterns)
        every += [(label, "id", f"x SPDX-License-Identifier: {x} y") for x in spdx] + [(label, "address", f"at https://{x} y") for x in url]
        for x in name:
            every += [(label, "grant", f"Licensed under the terms of the {x}."), (label, "version", f"The {x} version 2.0."), (label, "version" if x.endswith("1.0") else "name", f"The {x}.".upper())]
    every += [(label, "notice", f"x {wording.replace('...', 'Some Words').replace(' ', ',  ', 2)} y") for label, wording in licences.NOTICES]
    assert {e[:2] for e in every} == {(r[2], r[3]) for r in licences.rules()}
    every += [("cc0", "name", "CC0 1.0 Universal"), ("openssl", "name", "OpenSSL License"), ("odc-by", "name", "Open Data Commons Attribution License"), ("lgpl", "name", "GNU Library General Public License"), ("cddl", "name", "Common Development and Distribution License")]
    df = spark.createDataFrame([(i, e[2]) for i, e in enumerate(every)], "doc_id long, text string")
    got = {r.doc_id: {(d.label, d.form) for d in r.detections} for r in licences.scan(df).collect()}
    assert [e for i, e in enumerate(every) if e[:2] not in got[i]] == []


def test_licences_with_many_matches(spark):
    n = 20_000
    df = spark.createDataFrame([(1, "mit license, " * n), (2, "MIT" + " " * 50 + "\n license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.labelled(licences.scan(df)).collect()}
    assert (got[1].n_base, got[1].last_word, got[1].labels) == (n, 2 * n - 2, "mit") and (got[2].n_base, got[2].labels) == (1, "mit")
    assert got[2].score == 0.7  # by a rule, whatever the white space


# --- 9


def test_near_duplicates_against_brute_force(spark, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, passage = [], " ".join(word() for _ in range(80))
    for family in range(25):
        base = [word() for _ in range(rng.choice([30, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own) if rng.random() < 0.7 else " ".join(own).upper() + "!")
    texts += [" ".join([*(word() for _ in range(150)), passage, *(word() for _ in range(150))]) for _ in range(40)] + [None, "", "", "one two", "one two", "One, two!", "a b c d e", "..."]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id string, p int").unionByName(spark.createDataFrame([(None, "one two", "x", 1)], "doc_id long, text string, class_id string, p int"))
    cls = {r.doc_id: r.class_id for r in near_dups.near_duplicates(df).collect()}
    grams = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = classes = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both and both / len(grams[i] | grams[j]) >= 0.8:
                links += 1
                assert cls[i] == cls[j], (i, j)
    assert links > 100
    for i in range(175, 215):
        assert cls[i] == i  # texts that share a passage alone
    n = len(texts)
    assert cls[n - 8] == n - 8 and cls[n - 7] == cls[n - 6] == n - 7 and cls[n - 5] == cls[n - 4] == cls[n - 3] and cls[n - 1] == n - 1 and cls[None] is None
    assert near_dups.near_duplicates(none).count() == 0
    kept = near_dups.deduplicated(df).select("doc_id").collect()
    assert len({r.doc_id for r in near_dups.near_duplicates(df).filter("kept and doc_id is not null").collect()}) == len(set(cls.values()) - {None})
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(cls.values()) - {None}) and len(kept) == len(set(cls.values()))


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(4)
    with np.errstate(over="ignore"):
        for _ in range(60):
            a = rng.integers(0, 30, rng.integers(6, 40)).astype(np.uint16)
            b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 3)))
            x, y = near_dups.labels(a, 2), near_dups.labels(b, 2)
            table = np.zeros((len(x) + 1, len(y) + 1), int)
            for i in range(len(x)):
                for j in range(len(y)):
                    table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
            m = table[-1, -1]
            want = m / (len(x) + len(y) - m)
            got = near_dups.aligned(x, y, 0.5)
            assert len(set(x.tolist())) == len(x) and (abs(got - want) < 1e-9 if want >= 0.5 else got < 0.5)


# --- 10


def test_mixing(spark, odd, none):
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 300])), rng.choice(["b", "b", "b", "a", "c", None])) for i in range(600)]
    df = spark.createDataFrame([(*r, 9, "y") for r in rows], "doc_id long, text string, source string, size int, taken string")
    schedule, out = mixing.mix(df, block_words=64)
    got, total = out.collect(), sum(len(t.split()) for _, t, _ in rows)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    targets, left, weights = {}, float(total), {"a": 5, "b": 2, "c": 1, None: 5}
    while True:
        share = left / sum(w for s, w in weights.items() if s not in targets)
        over = [s for s, w in weights.items() if s not in targets and share * w > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            targets[s] = 3.0 * sizes[s]
        left = total - sum(targets.values())
    targets |= {s: share * w for s, w in weights.items() if s not in targets}
    assert len(got) == 600
    for r in got:
        assert abs(r.target - targets[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - targets[s]) <= 1
    slots = schedule.collect()
    assert sum(r.n_words for r in slots) == sum(r.taken for r in got)
    first = [r for r in slots if r.slot < max(x.slot for x in slots) / 4]  # any stretch of the schedule has the mix
    for s in sizes:
        assert abs(sum(r.n_words for r in first if r.source == s) / sum(r.n_words for r in first) - targets[s] / total) < 0.06
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), block_words=64)[1].collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix(odd)[1].count() == len(ODD) and mixing.mix(none)[1].count() == 0
    times = mixing.mixed(df).count()
    assert times > 0 and mixing.mixed(df).columns == df.columns


def test_near_duplicates_that_no_anchor_links(spark):
    """Many copies of one text, each with edits of its own: pairs are near 0.8, so anchors alone miss links."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(150)], []
    for _ in range(500):
        own = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            own[rng.randrange(len(own))] = word()
        texts.append(own)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = near_dups.signatures(df, 5, 16, 3, "doc_id", "text").select(F.col("doc_id").alias("rep"), "keys", "n", "bits", "words")
    cls = {r.doc_id: r.class_id for r in near_dups.near_duplicates(df).collect()}
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both / len(grams[i] | grams[j]) >= 0.8:
                assert cls[i] == cls[j], (i, j)
    # without any class, the open pairs and the anchors' pairs are all pairs of a bucket that can be links
    none = spark.createDataFrame([], "node long, class long")
    got = {(r.p, r.q) for part in (near_dups.candidates(found), near_dups.open_pairs(found, none, 0.8)) for r in part.collect()}
    keys = {r.rep: r["keys"] for r in found.collect()}
    bucket = {(i, j) for i in keys for j in keys if i < j and any(a == b for a, b in zip(keys[i], keys[j]))}
    assert got <= bucket
    with np.errstate(over="ignore"):
        sets = [set(near_dups.labels(near_dups.word_hashes(" ".join(w))).tolist()) for w in texts]
    assert {(i, j) for i, j in bucket if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8} <= got


def test_further_links_join_classes(spark):
    classes = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, class long")
    links = spark.createDataFrame([(2, 6), (7, 9), (2, 8)], "p long, q long")
    got = sorted(tuple(r) for r in near_dups.components(links, classes).select("node", "class").collect())
    assert got == [(1, 1), (2, 1), (5, 1), (6, 1), (7, 7), (8, 1), (9, 7)]


def test_words_of_one_crc_are_different_words(spark):
    """Short texts that differ in one word whose CRCs agree in their low 16 bits are not duplicates."""
    same = {}
    for i in range(70_000):
        same.setdefault(zlib.crc32(f"name{i}".encode()) & 0xFFFF, []).append(f"name{i}")
    pairs = [w[:2] for w in same.values() if len(w) > 1][:40]
    texts = [form.format(w) for form in ("{}", "dear {}", "dear {} your order is on its way") for pair in pairs for w in pair]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r for r in near_dups.near_duplicates(df).collect() if r.class_size != 1] == []
    assert near_dups.deduplicated(df).count() == len(texts)
    assert near_dups.unpacked(near_dups.packed(near_dups.words_of("A b, \u0130x\u00e9 _ \u4e2d 1"))) == near_dups.words_of("A b, \u0130x\u00e9 _ \u4e2d 1")


def test_repeated_ids_are_one_document(spark):
    rows = [(7, "a b c d e f g h", 1), (7, "i j k l m n o p", 2), (7, None, 3), (9, "i j k l m n o p", 4), (3, "a b c d e f g h", 5), (4, None, 6), (7, "i j k l m n o p", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    for _ in range(2):
        cls = {(r.doc_id, r.class_id, r.class_size) for r in near_dups.near_duplicates(df.repartition(3)).collect()}
        assert cls == {(7, 3, 6), (9, 3, 6), (3, 3, 6), (4, 4, 1)}
    rows = [(7, "a b c d e f g h", k) for k in range(40)]
    kept = {near_dups.deduplicated(spark.createDataFrame(rows, df.schema).repartition(k)).first().row for k in (1, 3, 7)}
    assert len(kept) == 1


def test_short_texts_that_differ_in_a_word(spark):
    """Texts of four and five k-mers, similar by exactly 0.8, meet for certain."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(300):
        words = [word() for _ in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)] if rng.random() < 0.5 else [" ".join(words[1:]), " ".join(words)]
    cls = {r.doc_id: r.class_id for r in near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(cls[i] == i - i % 2 for i in cls)


def test_tiles_of_a_large_bucket(spark):
    """Blocks of any size leave the same open pairs."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    texts = [" ".join(word() if rng.random() < 0.03 else w for w in base) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_dups.signatures(df, 5, 16, 3, "doc_id", "text").select(F.col("doc_id").alias("rep"), "keys", "n", "bits")
    classes = spark.createDataFrame([(i, i - i % 3) for i in range(60)], "node long, class long")
    pairs = [sorted(tuple(r) for r in near_dups.open_pairs(found, classes, 0.8, block=b).collect()) for b in (1024, 17)]
    assert pairs[0] == pairs[1] and pairs[0] and all(q >= 60 or p - p % 3 != q - q % 3 for p, q in pairs[0])


@pytest.mark.parametrize("name", ["op2_packing", "op5_quality", "op8_licences", "op9_near_dups"])
def test_registered_queries(spark, docs, name):
    """The queries themselves, each against a plain version or its own contract."""
    rows = queries.QUERIES[name](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    if name == "op2_packing":
        plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        plain.encode_special_tokens = True
        by_seq = {}
        got = {i: [] for i in texts}
        for r in rows:
            got[r.doc_id].append(r)
            by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, t in texts.items():
            ids, at = [*plain.encode(t, add_special_tokens=False).ids, 1], 0
            for r in sorted(got[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        for some in by_seq.values():
            some.sort()
            assert [o for o, _ in some] == list(np.cumsum([0] + [n for _, n in some])[:-1]) and sum(n for _, n in some) <= 2048
    elif name == "op5_quality":
        assert sorted(r.doc_id for r in rows) == sorted(texts)
        assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 and r.tail_prob <= r.expected_grade and r.keep == (r.tail_prob >= 0.5) for r in rows)
    elif name == "op8_licences":
        for r in rows:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scanned(texts[r.doc_id])
    else:
        grams = {}
        for i, t in texts.items():
            w = re.findall(r"\w+", t.lower())
            grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        cls = {r.doc_id: r.class_id for r in rows}
        for i in grams:
            for j in grams:
                if i < j and grams[i] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) and len(grams[i]) > 20:
                    assert cls[i] == cls[j]
