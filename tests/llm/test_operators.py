"""The operators over small tables of awkward rows, against plain versions."""

from __future__ import annotations

import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docengine.llm import ann, langid, merkle, mixing, packing, pii, simhash, substring, token_store, tokens, warc
from docengine.llm._common import Scratch

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PASSAGE = " ".join(f"shared{i}" for i in range(60))
rnd = random.Random(7)
WORDLIST = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDLIST) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text, lang, source): null and empty texts, a very long one, odd spaces, copies, ties, a null source."""
    base = prose(300, 1)
    edited = base.split(" ")
    edited[150] = "changed"
    texts = [None, "", " ", "one", "\n\n", base, base, " ".join(edited), prose(9000, 2), "tab\tand\r\nline  two  spaces ", "é ü ß 日本語 🙂 x", PASSAGE, f"{prose(50, 3)} {PASSAGE} {prose(50, 4)}", f"{PASSAGE} {PASSAGE}", "A B. C! " * 40, prose(35, 5), prose(34, 5), "x " * 500]
    return [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "é"][i % 4]) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns whose names the operators use themselves."""
    rows = spark.createDataFrame(awkward(), SCHEMA)
    return rows.withColumns({c: F.lit("own") for c in ("key", "ids", "size", "fp", "row_id", "tree", "bucket", "n", "rank", "start", "label")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(d, t) for d, t, _, _ in awkward()]


def test_token_files(spark, docs, empty):
    rows = token_store.token_store(docs, BYTES, 0).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, rows)) == brute.token_store(pairs())
    assert token_store.token_store(empty, BYTES, 0).count() == 0
    twice = docs.union(docs).select("doc_id", "text")
    rows = token_store.token_store(twice, BYTES, 0).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, rows)) == brute.token_store(pairs() * 2)


def test_token_file_gives_single_documents(spark, docs):
    scratch = Scratch(spark, "t")
    manifest = token_store.write_tokens(docs.where("doc_id > 4"), scratch.root, BYTES, 0)
    data = spark.read.format("binaryFile").load(f"{scratch.root}/dictionary").first().content
    encode = brute.ids_of("byte_bpe_50k.json")
    texts = dict(pairs())
    for r in manifest.collect():
        f = token_store.TokenFile(r.path, bytes(data))
        for i in reversed(range(f.documents)):
            assert f.ids(i).tolist() == [*encode(texts[f.index["doc_id"][i]]), 0]
        with pytest.raises(ValueError):
            token_store.TokenFile(r.path, b"another dictionary")


def test_null_ids_come_first(spark):
    rows = [(None, "b"), (3, "c"), (1, None), (None, "a")]
    got = token_store.token_store(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, 0)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()), key=lambda r: r[1]) == brute.token_store(rows)


PAGES = [(1, "http://a/x", "same"), (2, "http://a/y", "same"), (3, None, None), (4, "u v", ""), (5, "x", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3), (6, "x", "ü" * 40_000), (7, "x", "same"), (None, "x", "lost"), (8, "y", "WARC/1.1\r\nContent-Length: 999999\r\n\r\n")]


@pytest.mark.parametrize("range_bytes", [2000, 8 << 20])
def test_warc_round_trip(spark, range_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"path": F.lit(1), "of": F.lit(2)})
    scratch = Scratch(spark, "warc")
    records = warc.read_warc(warc.write_warc(pages, scratch.root), scratch, range_bytes)
    got = records.select("page_id", "payload_bytes", "payload_digest", "type", F.regexp_extract(F.coalesce("refers_to", F.lit("")), r"page:(\d+)", 1).alias("of"), "payload").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = brute.warc([(p, h) for p, _, h in PAGES])
    assert sorted([(r[0], r[1], r[2], r[3], int(r[4]) if r[4] else None) for r in got], key=key) == sorted(want, key=key)
    html = {p: (h or "").encode() for p, _, h in PAGES}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.type == "response")


@pytest.mark.parametrize("range_bytes", [2000, 90_000, 8 << 20])
def test_warc_headers_of_any_length(spark, range_bytes):
    url = "data:text/html," + "x" * 300_000
    pages = spark.createDataFrame([(i, url if i % 3 == 1 else "u", f"page {i}" * (i % 5)) for i in range(12)], "page_id long, url string, html string")
    scratch = Scratch(spark, "warc")
    got = warc.read_warc(warc.write_warc(pages.coalesce(1), scratch.root), scratch, range_bytes).collect()
    assert sorted((r.page_id, r.uri) for r in got) == sorted((r.page_id, r.url) for r in pages.collect())


def test_lost_records_make_the_read_fail(spark):
    scratch = Scratch(spark, "warc")
    files = warc.write_warc(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1), scratch.root)
    with pytest.raises(ValueError, match="3 records written, 2 can be read"):
        warc.read_warc(files.withColumn("records", F.col("records") + 1), scratch)


def test_warc_of_no_pages(spark):
    scratch = Scratch(spark, "warc")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(pages, scratch.root), scratch).count() == 0


def test_what_follows_a_broken_record_is_unreachable(tmp_path, spark):
    one = warc.record("response", 1, "u", b"abc", warc.digest(b"abc"), None)
    two = warc.record("response", 2, "u", b"def", warc.digest(b"def"), None)
    (tmp_path / "f.warc").write_bytes(one + b"junk" + two)
    files = spark.createDataFrame([(f"file://{tmp_path}/f.warc", len(one + b"junk" + two))], "path string, bytes long")
    assert [r.page_id for r in warc.read_warc(files, Scratch(spark, "warc"), 100).collect()] == [1]


def test_packing(spark, docs, empty):
    rows = packing.pack(docs, WORDS, 2).select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
    assert brute.check_packing(pairs(), [tuple(r) for r in rows]) == 0
    assert packing.pack(empty, WORDS, 2).count() == 0
    many = [(i, prose(5 + i * 37 % 900, i)) for i in range(300)]
    rows = packing.pack(spark.createDataFrame(many, "doc_id long, text string").repartition(5), WORDS, 2).select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
    assert brute.check_packing(many, [tuple(r) for r in rows]) == 0


def test_least_squares_finds_an_exact_mixture():
    h = np.zeros(64, dtype=np.int64)
    h[20], h[44], h[10], h[34] = 80, 50, 30, 30
    combos = packing.combinations(h, 64)
    x = packing.least_squares(combos, h)
    fit = np.zeros(64)
    for row, n in zip(combos, x):
        for length in row[row > 0]:
            fit[length] += n
    assert (x >= 0).all() and abs(fit - h).max() < 1
    p = packing.plan(h, 0, 64)
    assert p.line_tokens <= 64 * 3


TEXTS_PII = [
    "mail a.b@mail7.example.com and A.B@MAIL7.EXAMPLE.COM, call +1 (017) 555-7713 or +1 017 555 7713.",
    "card 4245100581169930, 4245-1005-8116-9930; ip 129.38.82.176 version 1.2.3 and 999.1.1.1",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" SSN 123-45-6789',
    "Frau Petra Klein sah Herr Klein; Господин Иванов. Nothing here 12345 2024-01-02",
    "clean text with words, 42 numbers and 3.14",
    None,
    "",
]


def test_surrogates(spark, empty):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS_PII * 2)]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string, kind string"), "k").collect()}
    n = len(TEXTS_PII)
    assert all(got[i].text == got[i + n].text for i in range(n)) and got[0].kind == "x"
    assert [got[i].text for i in range(4, n)] == TEXTS_PII[4:] and got[4].n_entities == 0 and got[5].n_entities == 0
    words = got[0].text.split(" ")
    assert "mail7" not in got[0].text.lower() and words[1].lower() == words[3].rstrip(",").lower() and words[3].isupper()
    assert "7713" not in got[0].text and got[0].text.count("+1 (") == 1
    digits = lambda s: "".join(c for c in s if c.isdigit())
    first, second = got[0].text.split("+1 ")[1:]
    assert digits(first) == digits(second)
    cards = got[1].text.split(" ")
    assert digits(cards[1]) == digits(cards[2]) and cards[2].count("-") == 3 and "129.38" not in got[1].text and "1.2.3" in got[1].text and "999.1.1.1" in got[1].text
    assert "04dbebab" not in got[2].text and 'token = "' in got[2].text and "123-45-6789" not in got[2].text
    assert "Petra" not in got[3].text and got[3].text.startswith("Frau ") and "Herr " in got[3].text and "Иванов" not in got[3].text and "2024-01-02" in got[3].text
    assert any("а" <= c <= "я" for c in got[3].text)
    assert pii.replace(empty, "k").count() == 0


@pytest.mark.parametrize("value", ["555-123-4567", "555.123.4567", "555 123 4567", "1-555-123-4567", "(555) 123.4567", "030 1234567", "01 23 45 67 89", "020 7946 0958", "378282246310005", "3782 822463 10005", "3056 930902 5904", "4222222222222", "6304000000000000000", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a", "2a00:1450::"])
def test_further_forms_of_private_data(spark, value):
    got = pii.replace(spark.createDataFrame([(1, f"see {value}, or {value}.")], "doc_id long, text string"), "k").first()
    assert got.n_entities == 2 and value not in got.text and got.text.startswith("see ") and got.text.endswith(".")
    digits = "".join(c for c in got.text[4:].split(",")[0] if c.isdigit())
    if len(value) > 12 and ":" not in value and not value.startswith(("0", "1", "(")):
        assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_names_after_further_forms_of_address(spark):
    text = "Dr. Anna Klein, Prof Weber, Frau Dr. Petra Klein, Sr. García, Sir Henry and Доктор Иванов"
    got = pii.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert got.n_entities == 6 and "Frau Dr. " in got.text and not any(n in got.text for n in ("Anna Klein", "Weber", "Petra", "García", "Henry", "Иванов"))


def test_numbers_that_are_no_cards_or_phones_stay(spark):
    text = "378282246310006 and 1700000000000 at 10:20:30 on 01-02-2024 10:00, std::vector, 00:1a:2b:3c:4d:5e, 3.14.15"
    got = pii.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert got.text == text and got.n_entities == 0


def test_surrogates_stay_distinct(spark):
    """More entities than a small space holds without collisions: all names after one form of address, and addresses."""
    rows = [("ipv4", f"10.0.{i // 256}.{i % 256}") for i in range(3000)] + [("phone", f"+1017555{i:04d}") for i in range(2000)]
    entities = spark.createDataFrame([(*r, "") for r in rows], "kind string, value string, gender string")
    got = pii.surrogates(entities, Scratch(spark, "pii"), "k").collect()
    assert len(got) == 5000 and len({(r.kind, r.plain) for r in got}) == 5000
    assert not {(r.kind, r.plain) for r in got} & set(rows)
    again = pii.surrogates(entities, Scratch(spark, "pii"), "k").collect()
    other = pii.surrogates(entities, Scratch(spark, "pii"), "another key").collect()
    assert sorted(got) == sorted(again) and sorted(got) != sorted(other)


def test_colliding_surrogates_are_made_again(spark):
    """More names than their shortest form has: they grow."""
    names = [("given", f"{a}{b}{c}", g) for a in "ABCDEFGH" for b in "abcdefghij" for c in "klmnopqrst" for g in "m"]
    names += [("family", f"F{i}", "") for i in range(3000)]
    got = pii.surrogates(spark.createDataFrame(names, "kind string, value string, gender string"), Scratch(spark, "pii"), "k").collect()
    assert len({(r.kind, r.plain) for r in got}) == len(names)
    few = spark.createDataFrame([("given", f"G{i}", "m") for i in range(3000)], "kind string, value string, gender string").withColumn("kind", F.lit("given"))
    assert few.select(pii._name(pii._digest("k", F.lit("x"), F.lit("y"), F.lit(0)), F.lit(9), F.lit("Abc"), 3, lambda _: F.lit("")).alias("n")).first().n.isalpha()


def test_hmac_is_the_standard_one(spark):
    import hashlib
    import hmac

    row = spark.range(1).select(pii.hmac("key", F.lit("text é")).alias("a"), pii.hmac("long" * 40, F.lit("x")).alias("b")).first()
    assert row.a == hmac.new(b"key", "text é".encode(), hashlib.sha256).hexdigest()
    assert row.b == hmac.new(b"long" * 40, b"x", hashlib.sha256).hexdigest()


def test_surrogates_need_a_key(spark, docs):
    with pytest.raises(ValueError):
        pii.replace(docs, "")
    own = pii.session_key(spark)
    assert own == pii.session_key(spark) and len(own) == 64
    spark.conf.set(pii.KEY, "told")
    assert pii.session_key(spark) == "told"
    spark.conf.unset(pii.KEY)


def test_entities_stay_distinct_and_the_same_everywhere(spark):
    """Every mention of an entity, in whatever form, gets its surrogate in that form; no two entities share one, and none is a real value."""
    r = random.Random(11)
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    entities = []  # forms of one entity, and what their surrogates must have in common
    for i in range(60):
        d = digits(10)
        entities.append(([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"+1 {d[:3]} {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"], lambda x: "".join(c for c in x if c.isdigit())[-10:]))
        secret = "".join(r.choice("0123456789abcdef") for _ in range(24))
        entities.append(([f'token = "{secret}', f"api_key: {secret}"], lambda x: x.split()[-1].strip('"')))
        entities.append(([f"user{i}@corp{i}.com", f"USER{i}@CORP{i}.COM"], lambda x: x.lower()))
        card = digits(16)
        entities.append(([card, " ".join(card[k : k + 4] for k in range(0, 16, 4))], lambda x: x.replace(" ", "")))
        family = "K" + "".join(r.choice("abcdefgh") for _ in range(8))
        entities.append(([f"Mrs {family}", f"Miss {family}", f"Dr. Joan {family}"], lambda x: x.split()[-1]))
    rows, places = [], []
    for k, (forms, _) in enumerate(entities):
        for form in forms * 2:
            places.append((len(rows), k))
            rows.append((len(rows), f"x | {form} | y"))
    r.shuffle(rows)
    got = {x.doc_id: x.text.split(" | ") for x in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    real = {same(f) for forms, same in entities for f in forms}
    surrogate: dict = {}
    for doc, k in places:
        assert got[doc][0] == "x" and got[doc][2] == "y"
        surrogate.setdefault(k, set()).add(entities[k][1](got[doc][1]))
    assert all(len(v) == 1 for v in surrogate.values())
    flat = [next(iter(v)) for v in surrogate.values()]
    assert len(set(flat)) == len(flat) and not set(flat) & real


def test_later_mentions_of_a_name(spark):
    text = "Mr John Klein came. Klein said that John left; Kleinstadt and john stay. My name is Mary Stone. Dear Otto Berg, Stone"
    got = pii.replace(spark.createDataFrame([(1, text), (2, "Klein and Stone are words here")], "doc_id long, text string"), "k").collect()
    by = {x.doc_id: x for x in got}
    words = by[1].text.replace(".", "").split(" ")
    assert words[0] == "Mr" and words[2] == words[4] and words[1] == words[7] and "Kleinstadt and john stay" in by[1].text
    assert not any(n in by[1].text.replace("Kleinstadt", "") for n in ("John", "Klein", "Mary", "Stone", "Otto", "Berg")) and by[2].text == "Klein and Stone are words here"


def test_private_data_in_a_very_long_text(spark):
    text = "word " * 200_000 + "mail a.b@mail1.example.com " * 3000
    got = pii.replace(spark.createDataFrame([(1, text, "n", "r")], "doc_id long, text string, n_entities string, row string"), "k").first()
    assert got.n_entities == 3000 and "mail1" not in got.text and len(got.text.split()) == len(text.split()) and got.row == "r"


LANGS = {"en": ["the", "and", "with", "thing", "ation", "shall"], "de": ["und", "schön", "zeit", "straße", "ung", "nicht"], "fr": ["être", "où", "ça", "les", "ment", "eaux"], "es": ["ción", "niño", "que", "los", "mente", "año"], "it": ["gli", "che", "zione", "della", "più", "anche"], "pt": ["ção", "não", "uma", "muito", "também", "lhe"]}


def test_language_codes():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_language_id(spark, docs, empty):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(LANGS[lang]) for _ in range(30)), lang) for i, lang in enumerate(list(LANGS) * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame, F.col("doc_id") % 4 != 2)
    got = langid.predict(frame.withColumn("score", F.lit("own")), model).where("doc_id % 4 = 2")
    assert got.where("lang_pred = lang").count() / got.count() > 0.95
    assert got.where("score < 0 or score > 1").count() == 0
    odd = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(docs, model).collect()}
    assert [odd[i] for i in (0, 1, 2, 4)] == [("und", 0.0)] * 4 and odd[8][0] in LANGS
    assert langid.predict(empty, model).count() == 0 and langid.train(empty).predict("text")[0] == "und"


def test_merkle(spark, docs, empty):
    got = {r.doc_id: r for r in merkle.compare_edits(docs).collect()}
    texts = [t or "" for _, t in pairs()]
    import hashlib

    prints = {}
    for i, t in enumerate(texts):
        k, nxt = len(t) // 4, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - k] + nxt[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for text, print_ in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(text, print_) == print_
    assert len(set(prints.values())) == len(prints)
    assert got[5].near_next == 1.0 and got[6].near_next > 0.5 and got[6].near_edited > 0.5 and got[8].near_edited > 0.6 > got[8].near_next
    assert merkle.compare_edits(empty).count() == 0
    one = merkle.compare_edits(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_merkle_root_and_likeness_by_brute_force(spark, docs):
    texts = [t or "" for _, t in pairs()]
    got = {r.doc_id: r for r in merkle.compare_edits(docs).collect()}
    for i, t in enumerate(texts):
        k, following = len(t) // 4, texts[(i + 1) % len(texts)]
        trees = [brute.merkle(x) for x in (t, t[: len(t) - k] + following[:k], following)]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (trees[0][0], trees[1][0])
        assert abs(got[i].near_edited - brute.alike(trees[0], trees[1])) < 1e-12
        assert abs(got[i].near_next - brute.alike(trees[0], trees[2])) < 1e-12


def test_merkle_locates_edits(spark):
    a = "one\ntwo\n\nthree\nfour"
    cases = [(a, "one\ntwo\n\nthree\nFOUR", [(1, 1)]), ("new\n" + a, a, [(0, 0)]), ("one\ntwo\n\nthree\nmore\nfour", a, [(1, 1)]), (a, a, []), ("", a, []), (a, "", [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)])]
    frame = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(cases)], "i int, a string, b string")
    rows = frame.select("i", merkle.edits(merkle.summary(F.col("a")), merkle.summary(F.col("b"))).alias("e")).collect()
    got = {r.i: [tuple(x) for x in r.e] for r in rows}
    assert [got[i] for i in range(3)] == [c[2] for c in cases[:3]] and got[3] == [] and got[4] == []
    assert len(got[5]) >= 4


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_next_document_over_ranges(spark, bucket_rows):
    rows = [(i * 7 % 50, f"t{i}") for i in range(50)] + [(None, "n"), (3, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted([(d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)], key=str)
    got = merkle.with_next(frame, Scratch(spark, "t"), bucket_rows).select("doc_id", "text", "next.text").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_mixing(spark, docs, empty):
    rows = docs.select("doc_id", "text", "source").union(docs.select("doc_id", "text", "source").where("doc_id = 5"))
    got = [r.asDict() for r in mixing.mix(rows, block_words=16).collect()]
    assert len(got) == rows.count()
    texts = dict(pairs())
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode().split()) and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes: dict = {}
    taken: dict = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = brute.targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 4 * 16 for s in sizes)  # the points are off by a few blocks
    assert taken == brute.taken(sizes, want, 16)
    slots = [r["first_slot"] for r in got if r["taken"]]
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in got) and max(slots) > len(slots) / 4
    again = [r.asDict() for r in mixing.mix(rows.repartition(7), block_words=16).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0
    assert mixing.mix(docs.where("text is null")).first().taken == 0
    copies = mixing.repeat(docs)
    assert copies.columns == docs.columns and copies.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_schedule_is_near_its_weights(spark):
    plan = spark.createDataFrame([(1, 500.0 * 32), (2, 300.0 * 32), (3, 200.0 * 32)], "n int, target double")
    slots = sorted(mixing.schedule(spark, plan).collect())
    assert [s.slot for s in slots] == list(range(1000))
    for n in (1, 2, 3):
        assert [s.rank for s in slots if s.n == n] == list(range(sum(s.n == n for s in slots)))
    for cut in (100, 333, 700, 1000):
        for n, share in ((1, 0.5), (2, 0.3), (3, 0.2)):
            assert abs(sum(s.n == n for s in slots[:cut]) - cut * share) < 3


def test_the_points_shape_the_mix(spark, docs, monkeypatch):
    """Other points give another mix: counts and order come from the schedule."""
    before = {r.doc_id: (r.taken, r.first_slot) for r in mixing.mix(docs, block_words=16).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 1 << 29)
    after = {r.doc_id: (r.taken, r.first_slot) for r in mixing.mix(docs, block_words=16).collect()}
    assert before != after


def test_repeated_rows_come_in_slot_order(spark, docs, monkeypatch):
    rows = mixing.mix(docs, block_words=16).where("taken >= size").select("doc_id", "first_slot").collect()
    first = {r.doc_id: r.first_slot for r in rows}
    got = [r.doc_id for r in mixing.repeat(docs, block_words=16).collect()]
    seen = [d for i, d in enumerate(got) if d in first and d not in got[:i]]
    assert seen == sorted(seen, key=first.__getitem__)
    monkeypatch.setattr(mixing, "small_enough", lambda *_: False)
    assert [r.doc_id for r in mixing.repeat(docs, block_words=16).collect()] == got


def test_fingerprints_and_components(spark, docs, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {d: brute.simhash(t) for d, t in pairs()}
    assert {d: r.p0 % (1 << 64) for d, r in got.items()} == prints
    assert {d: r.component_id for d, r in got.items()} == brute.components(prints)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block_rows", [8192, 16])
def test_links_join_what_all_pairs_join(spark, block_rows):
    """Random fingerprints, chains of near ones and a dense ball, with and without buckets dealt out in blocks."""
    r = random.Random(5)
    prints = [r.getrandbits(64) for _ in range(200)]
    for _ in range(150):  # chains
        x = prints[-1]
        for b in r.sample(range(64), r.randint(1, 5)):
            x ^= 1 << b
        prints.append(x)
    centre = r.getrandbits(64)
    for _ in range(150):
        x = centre
        for b in r.sample(range(64), r.randint(0, 4)):
            x ^= 1 << b
        prints.append(x)
    items = dict.fromkeys(prints)
    items = {x: x for x in items}
    signed = [x - (1 << 64) if x >> 63 else x for x in items]
    frame = spark.createDataFrame([(x, x) for x in signed], "id long, p0 long")
    scratch = Scratch(spark, "t")
    edges = simhash.links(frame, scratch, block_rows=block_rows)
    assert all((a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 4 for a, b in edges.collect())
    label = labels_of(spark, frame, simhash.components(edges, scratch))
    want = brute.components(items)
    for a in items:
        for b in items:
            if a < b:
                assert (want[a] == want[b]) == (label[a] == label[b])


def labels_of(spark, nodes, labels):
    """id (unsigned) -> label; nodes without links are their own."""
    rows = nodes.join(labels, F.xxhash64("id") == F.col("node"), "left").select("id", "label")
    return {r.id % (1 << 64): r.label if r.label is not None else ("own", r.id) for r in rows.collect()}


@pytest.mark.parametrize("size", [2, 3, 64, 65, 1000, 10_000])
def test_a_bucket_sends_a_forest(size):
    """Whatever a bucket's size, a task sends one link less than there are texts, the nearest ones."""
    from docengine.llm import _graph

    r = np.random.RandomState(size)
    near = np.stack([r.randint(0, k + 1, 8) for k in range(size - 1)])  # each node with some before it
    a, b = near.ravel(), np.repeat(np.arange(1, size), 8)
    kept = _graph.forest(a, b, r.randint(0, 5, len(a)))
    assert len(kept) == size - 1
    root = list(range(size))
    for x, y in zip(a[kept].tolist(), b[kept].tolist()):
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        assert x != y  # no circle
        root[max(x, y)] = min(x, y)


def test_forest_takes_the_nearest_links():
    from docengine.llm import _graph

    a, b, d = np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([3, 9, 2])
    assert sorted(_graph.forest(a, b, d).tolist()) == [0, 2]


@pytest.mark.parametrize("shape", ["chain", "star", "tree"])
def test_components_of_large_shapes(spark, shape):
    r = random.Random(1)
    nodes = r.sample(range(10_000), 1200)
    ends = {"chain": zip(nodes, nodes[1:]), "star": ((nodes[0], x) for x in nodes[1:]), "tree": ((nodes[(k - 1) // 2], nodes[k]) for k in range(1, 1200))}
    edges = [*ends[shape], (20_000, 20_001), (20_001, 20_002)]
    labels = simhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    frame = spark.createDataFrame([(x,) for x in [*nodes, 20_000, 20_001, 20_002]], "id long")
    got = labels_of(spark, frame, labels)
    assert len({got[x] for x in nodes}) == 1 and len({got[x] for x in (20_000, 20_001, 20_002)}) == 1 and len(set(got.values())) == 2
    none = spark.createDataFrame([], "a long, b long")
    assert simhash.components(none, Scratch(spark, "t")).count() == 0


def test_spread_join_deals_out_hot_keys(spark, monkeypatch):
    from docengine.llm import _common

    monkeypatch.setattr(_common, "small_enough", lambda *a, **k: False)
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(i, i) for i in range(2, 100)], "k long, x long")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(120)], "k long, v string")
    got = _common.spread_join(left, right, "k", slices=10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_keep_one(spark, docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    sets = {d: frozenset(simhash.shingles(t, 5).tolist()) for d, t in pairs()}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and alike(sets[a], sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if x == old else x for d, x in root.items()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == root
    assert simhash.keep_one(docs.union(docs)).count() == kept.count() and simhash.keep_one(empty).count() == 0
    clash = docs.withColumns({"p0": F.lit(2), "digest": F.lit(3), "label": F.lit(4), "first": F.lit(5)})
    assert simhash.keep_one(clash).count() == kept.count()
    no_ids = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one(no_ids).count() == kept.count()


def test_near_copies_are_those_of_equal_shingles(spark):
    """Pairs of just under 0.8 are never linked, of exactly 0.8 as often as the tables promise, whatever their length."""
    r = random.Random(5)
    rows, want = [], 0
    for k in range(400):
        n = (9, 36, 90, 180)[k % 4]  # shingles; the last word's change costs one, so do the last m words cost m
        words = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
        m = n // 9 + (k % 8 >= 4) * max(1, n // 45)
        other = words[:-m] + [f"v{r.randrange(10**6)}" for _ in range(m)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want += (n - m) / (n + m) >= 0.8
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.SIMILAR)
    kept = {x.doc_id for x in got.select("doc_id").collect()}
    linked = [k for k in range(400) if 2 * k + 1 not in kept]
    assert want == 200 and set(linked) <= {k for k in range(400) if k % 8 < 4} and len(linked) >= 194


def test_layouts_grow_with_the_rows():
    """Segments widen with the logarithm of the rows and stay within their prints."""
    last = 0
    for rows in (0, 10**3, 10**6, 10**9, 10**11):
        how = simhash.layout(rows)
        assert all(first + bits <= 64 and word < how.prints for word, first, bits, _ in how.segments)
        assert len(how.segments) >= last and len(set(how.segments)) == len(how.segments)
        last = len(how.segments)


def test_search(spark):
    r = np.random.RandomState(0)
    centres = r.randn(12, 16)
    vectors = {i: (centres[i % 12] + 0.4 * r.randn(16)).tolist() for i in range(3000)}
    vectors |= {i: vectors[1] for i in range(3000, 3400)}  # one very common vector
    rows = [*vectors.items(), (5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [1.0] * 3), (None, [1.0] * 16), (5004, [None] + [1.0] * 15)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got: dict = {}
    for x in ann.search(frame, rerank=200).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
        assert abs(x.score - float(np.dot(vectors[x.query_id], vectors[x.vec_id]))) < 1e-9
    want = brute.nearest(vectors)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    again = ann.search(frame, rerank=1, block=500, query_bytes=2000).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.vec_id) for x in again] == [(q, v) for q in sorted(got) for v in got[q]]
    assert ann.search(frame.limit(0)).count() == 0 and ann.search(frame.where("vec_id < 3")).count() == 2


@pytest.mark.parametrize("noise", [0.1, 0.01, 0.0])
def test_search_finds_all_nearest_in_a_hot_group(spark, noise):
    """A third of the vectors are near copies of one point, which the codes can't tell apart."""
    r = np.random.RandomState(3)
    x = r.randn(9000, 64) / 8
    hot = r.permutation(9000)[:3000]
    x[hot] = x[hot[0]] + noise * r.randn(3000, 64) / 8
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got: dict = {}
    for f in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=60).orderBy("query_id", "rank").collect():
        got.setdefault(f.query_id, []).append(f.vec_id)
    assert got == brute.nearest({i: np.array(v) for i, v in rows}, every=60)


def test_search_of_several_lengths_and_few_vectors(spark):
    r = np.random.RandomState(8)
    vectors = {i: r.randn((3, 8, 16)[i % 3]) for i in range(90)}
    got: dict = {}
    for x in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>"), every=5, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    for q, found in got.items():
        assert found == brute.nearest({i: v for i, v in vectors.items() if len(v) == len(vectors[q])} | {q: vectors[q]}, every=5, k=4)[q]
    assert len(got) == 18


def test_anisotropic_codes_keep_inner_products_better():
    r = np.random.RandomState(1)
    x = r.randn(2000, 16)
    x /= np.sqrt((x**2).sum(1, keepdims=True))

    def along(q):
        codes = q.assign(x)
        coded = q.books[np.arange(q.books.shape[0]), codes].reshape(x.shape)
        return float(np.abs(((x - coded) * x).sum(1)).mean())

    assert along(ann.fit(x, 8.0)) < along(ann.fit(x, 1.0))


def test_repeats(spark, docs, empty):
    rows = substring.remove_repeats(docs).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows}
    want = brute.remove_repeats([t for _, t in pairs()])
    assert [got[i] for i in range(len(want))] == want
    for r in rows:
        assert sum(b - a for a, b in r.spans) == r.n_removed
    assert substring.remove_repeats(empty).count() == 0
    twice = sorted((r.doc_id, r.n_removed, r.kept) for r in substring.remove_repeats(docs.union(docs)).collect())
    want = brute.remove_repeats([t for _, t in pairs()] * 2)
    assert twice == sorted((i % len(pairs()), w[1], w[2]) for i, w in enumerate(want))


@pytest.mark.parametrize("hot", [4000, 2])
def test_repeats_with_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    r = random.Random(2)
    passages = [[r.choice(WORDLIST) for _ in range(n)] for n in (34, 35, 36, 50, 120)]
    texts = []
    for _ in range(60):
        words: list[str] = []
        for _ in range(r.randint(1, 4)):
            words += [r.choice(WORDLIST) for _ in range(r.randint(0, 20))] + r.choice(passages)[r.randint(0, 3) :]
        texts.append(" ".join(words))
    rows = substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(x.n_words, x.n_removed, x.kept) for x in sorted(rows)] == brute.remove_repeats(texts)


@pytest.mark.parametrize("window", [2, 11, 72, 90])
def test_repeats_of_other_windows(spark, window):
    r = random.Random(window)
    passage = [r.choice(WORDLIST) for _ in range(200)]
    cuts = [(0, 200), (30, 150), (100, 190), (55, 145), (0, 89)]
    texts = [" ".join([f"w{i}", *passage[a:b], f"v{i}", *[r.choice(WORDLIST) for _ in range(30)]]) for i, (a, b) in enumerate(cuts)]
    rows = substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window).collect()
    assert [(x.n_words, x.n_removed, x.kept) for x in sorted(rows)] == brute.remove_repeats(texts, window)


def test_automaton_counts_all_substrings():
    r = random.Random(4)
    strings = [[r.randint(0, 2) for _ in range(r.randint(1, 25))] for _ in range(12)]
    a = substring.Automaton()
    for s in strings:
        a.add(s, 1)
    a.finish()
    for k in (1, 3, 6):
        for s in strings:
            want = [sum(t[j : j + k] == s[i : i + k] for t in strings for j in range(len(t) - k + 1)) >= 2 for i in range(len(s) - k + 1)]
            assert a.repeats(s, k) == want


def test_slots_of_many_rows_are_not_told_to_all_tasks(spark):
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("s").alias("source"))
    got = mixing.repeat(rows)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 12_000


def test_the_plan_of_packing_holds_few_combinations():
    import tracemalloc

    counts = np.random.default_rng(1).integers(1, 400, packing.WINDOW)
    tracemalloc.start()
    combos = packing.combinations(counts, packing.WINDOW)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20 and len(combos) == packing.COMBINATIONS
    room = packing.COMBINATIONS - packing.WINDOW // 2
    every = [(-min(counts[a], counts[b], counts[c]), a, b) for a in range(1, 1366) for b in range(a, (4096 - a) // 2 + 1) for c in (4096 - a - b,)]
    assert [tuple(r[:2]) for r in combos[-room:].tolist()] == [(a, b) for _, a, b in sorted(every)[:room]]


def test_near_dedup_and_mixing_leave_what_their_results_read(spark, docs, monkeypatch, tmp_path):
    import os

    for name, operator, left in (("keep-one", simhash.keep_one, ["gone", "rows"]), ("mixed", mixing.repeat, ["both"])):
        monkeypatch.setattr(mixing, "small_enough", lambda *_: False)
        monkeypatch.setattr("docengine.llm._common.shared_folder", lambda _, n=name: f"file://{tmp_path}/{n}")
        assert operator(docs).count() > 0
        (folder,) = (tmp_path / name).iterdir()
        assert sorted(os.listdir(folder)) == left


def test_release_lets_the_last_shuffle_go(spark, tmp_path):
    from docengine.llm._common import release

    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("|")
        return {f for f in files.split("|") if "shuffle_" in f and f.endswith(".data")}

    release(spark)
    before = shuffled()
    spark.range(10_000).repartition(5, "id").write.parquet(str(tmp_path / "x"))
    assert shuffled() - before
    release(spark)
    assert not shuffled() - before


def test_similar_texts_are_linked_though_nearer_candidates_fail(spark):
    """Of each three texts the first two have similarity 0.81; both lie nearer to the third by SimHash, whose similarity to them is 0.79."""
    texts = []
    for seed in (3, 7, 11, 34, 40, 41, 55, 57):
        r = random.Random(seed)
        w = [f"w{r.randrange(10**6)}" for _ in range(100)]
        b = w[:10] + [f"b{r.randrange(10**6)}" for _ in range(6)] + w[16:]
        c = w[:10] + [f"c{r.randrange(10**6)}" for _ in range(7)] + w[17:]
        texts += [" ".join(x) for x in (w, b, c)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(simhash.near_copies(rows).collect())
    assert got == {i: i - (i % 3 == 1) for i in range(len(texts))}
    kept = simhash.keep_one(rows).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [i for i in range(len(texts)) if i % 3 != 1]


def test_uncompared_candidates_in_parts(spark, monkeypatch):
    """Mutations of one text around the threshold: the groups are those of all candidates, however many are compared at a time."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    texts = []
    for _ in range(60):
        w, at = list(base), r.randrange(93)
        w[at : at + 5] = [f"x{r.randrange(10**6)}" for _ in range(5)]
        texts.append(" ".join(w))
    how = simhash.layout(len(texts))
    sets = [np.unique(simhash.shingles(t, 5)) for t in texts]
    prints = [simhash.votes(s, how.prints) for s in sets]

    def candidate(p, q):
        near = sum((x ^ y).bit_count() for x, y in zip(p, q)) <= how.radius
        return near and any((((p[k] ^ q[k]) >> f) & ((1 << n) - 1)).bit_count() <= 1 for k, f, n, _ in how.segments)

    group = list(range(len(texts)))
    failed = 0
    for a in range(len(texts)):
        for b in range(a):
            if candidate(prints[a], prints[b]):
                if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])):
                    group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
                else:
                    failed += 1
    assert failed > 100 and len(set(group)) > 5
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for compared in (simhash.COMPARED, 400):
        monkeypatch.setattr(simhash, "COMPARED", compared)
        assert dict(simhash.near_copies(rows).collect()) == dict(enumerate(group))


def test_sketches_rule_out_no_similar_pair():
    r = np.random.default_rng(3)
    for n in (0, 1, 9, 100, 5000):
        for other in (0, 1, n // 10, n // 9, n):
            x = r.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.unique(np.concatenate([x[: n - other], r.integers(0, 1 << 63, other, dtype=np.uint64)]))
            x = np.unique(x)
            differ = int(np.bitwise_count(simhash.sketch(x) ^ simhash.sketch(y)).sum())
            assert differ <= len(np.setxor1d(x, y))
            for least in (0.5, 0.8, 0.9):
                similar = len(np.intersect1d(x, y)) >= least * len(np.union1d(x, y)) - 1e-9
                assert simhash.may_be_similar(len(x), len(y), differ, least) or not similar
    assert simhash.may_be_similar(100, 80, 0, 0.8) and not simhash.may_be_similar(100, 79, 0, 0.8)
    assert simhash.may_be_similar(90, 90, 20, 0.8) and not simhash.may_be_similar(90, 90, 21, 0.8)


def test_unlike_candidates_between_groups_are_no_pairs(spark):
    """Mutations of one text, most of them just below the threshold: sketches leave few pairs besides the similar ones, and all of these."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        w, at = list(base), r.randrange(140)
        w[at : at + 8] = [f"x{r.randrange(10**6)}" for _ in range(8)]
        texts.append(" ".join(w))
    how = simhash.layout(len(texts))
    sets = [np.unique(simhash.shingles(t, 5)) for t in texts]
    values = [np.array([*simhash.votes(s, how.prints), len(s), *simhash.sketch(s)], dtype=np.uint64).view(np.int64).tolist() for s in sets]
    names = [*[f"p{k}" for k in range(how.prints)], "n", *simhash.SKETCHES]
    frame = spark.createDataFrame([(i, i, *v) for i, v in enumerate(values)], ", ".join(f"{n} long" for n in ["id", "label", *names]))
    scratch = Scratch(spark, "t")
    every = set(map(tuple, simhash.links(frame, scratch, how, name="every").collect()))
    left = set(map(tuple, simhash.links(frame, scratch, how, name="left", least=0.8).collect()))
    similar = {(a, b) for a, b in every if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9}
    assert similar <= left < every and len(similar) > 100
    assert len(every) > 5 * len(similar) and len(left) < 1.2 * len(similar)


@pytest.mark.parametrize("name, byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_with_marks_or_a_line_break_are_cut_there(name, byte_level):
    """Their parts are encoded, as words and runs of marks; all ids are the library's."""
    import pyarrow as pa

    plain = [a + m + b for a in ("word", "Éa", "s") for m in ("$$$", "***.", ".\nNext", "\ns,", "'", "'\nre!", "<\nß") for b in ("", "%%") if m[-1].isalpha() or not b]
    odd = ["it's", "a,b", "a.\n\nb", "a\n", "\na", "a.\r\nb", "w" + "$" * 9, "w" + "." * 8 + "\nv" + "." * 9, "İ.\nx", "x\u0338", "x<\u0338", "x\n\u0301y", "5.\nx", "<|endoftext|>"]
    work = tokens.Encoder(public_tokenizers.path(name), byte_level)
    whole, pieces = [], work._pieces
    work._pieces = lambda p: whole.extend(p) or pieces(p)
    texts = [*plain, *odd, " ".join(plain), " ".join(odd), "x " + " ".join(plain)]
    ids = brute.ids_of(name)
    got = [np.frombuffer(x, "<u2").tolist() for x in work.encode(pa.array(texts))]
    assert got == [ids(t) for t in texts]
    assert not {p.strip(" ") for p in whole} & set(plain)
