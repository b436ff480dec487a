"""WARC archives, surrogates, Order MinHash and the pipeline."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ionlake.llm import decontaminate, ordermin, pii, simhash, warc


@pytest.mark.parametrize("limits", [{}, {"SOURCES": 1, "SALTS": 2}, {"LARGE": 1500, "FILE_BYTES": 5000, "RECORDS": 2}])
def test_archives_round_trip(spark, tmp_path, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(warc, name, value)
    big = "<p>" + "é" * 600 + "\r\n\r\nWARC/1.1\r\n" + "</p>"
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (None, "n", big), (8, "u", "z" * 1000), (8, "u", "z" * 1000), (9, "u", "z" * 999), (10, "u", "z" * 999), (11, "u", "y" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record_type": F.lit(1), "payload_bytes": F.lit("x")})
    got = warc.round_trip(df, f"{tmp_path}/w").collect()
    assert len(got) == len(rows)
    best = {big: 7, "z" * 1000: 8}
    for page, _, html in rows:
        body = (html or "").encode()
        for r in (r for r in got if r.page_id == page):
            own = best.get(html) if len(body) >= 1000 else None
            revisit = own is not None and own != page
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", own if revisit else None)
    if limits.get("RECORDS"):
        import gzip

        sizes = [len(gzip.decompress(p.read_bytes())) for p in tmp_path.glob("w/**/*.gz")]
        assert sum(n > 6000 for n in sizes) == 1  # the one record that is larger
    stored = {r.page_id: r for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert bytes(stored[7].payload).decode() == big and stored[1].payload is None and stored[2].url == "http://b%0D%0AX: y"
    assert warc.round_trip(df.limit(0), f"{tmp_path}/e").count() == 0


def test_pages_of_many_files(spark, tmp_path, monkeypatch):
    """Originals and revisits in different files, read where they lie; one huge page doesn't scatter the others."""
    monkeypatch.setattr(warc, "SOURCES", 3)
    body = {0: "a" * 1500, 1: "b" * 999, 2: "c" * 70_000, 3: "d" * 90_000}
    rows = [(i, f"u{i}", body[i % 4] + (str(i) if i % 8 == 3 else "")) for i in range(400)] + [(400, "u", "e" * 20_000_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9).write.parquet(f"{tmp_path}/pages")
    got = {r.page_id: r for r in warc.round_trip(spark.read.parquet(f"{tmp_path}/pages"), f"{tmp_path}/w").collect()}
    best = {}
    for page, _, html in rows:
        best[html] = max(page, best.get(html, 0))
    for page, _, html in rows:
        revisit = len(html) >= 1000 and best[html] != page
        assert (got[page].record_type, got[page].refers_to, got[page].payload_bytes) == ("revisit" if revisit else "response", best[html] if revisit else None, len(html))
    assert len(got) == len(rows)
    large = list(tmp_path.glob("w/large/**/*.gz"))
    assert len(large) < 20  # some 50 pages of 90 KB, one of 70 KB and one of 20 MB by nine tasks


def test_headers_are_fresh_and_complete(spark, tmp_path):
    import gzip

    warc.write(spark.createDataFrame([(1, "u", "a" * 2000), (2, "u", "a" * 2000)], "page_id long, url string, html string"), f"{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("w/*.gz"))
    found = sorted(warc.parse(data), key=lambda r: r[0]["warc-type"])
    (response, payload), (revisit, none) = found
    assert payload == b"a" * 2000 and none == b"" and revisit["warc-refers-to"] == response["warc-record-id"] and revisit["warc-profile"] == warc.PROFILE
    assert revisit["warc-payload-digest"] == response["warc-payload-digest"] and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", revisit["warc-date"])


TEXT = "Dear Maria Schmidt, Frau Schmidt and Mr. Smith: maria@foo-bar.co.uk, 10.1.2.3, +1 (319) 555-5132, 4111 1111 1111 1111, 123-45-6789, DE89 3704 0044 0532 0130 00, Иван Петров; 4111111111111112, version 1.2.3, The The."


def test_surrogates_keep_type_format_and_coreference(spark):
    rows = [(1, TEXT, 5), (2, None, 0), (3, "", 0), (4, "No entity here. Of Of The The 12345", 7), (5, TEXT, 5), (5, TEXT, 5), (None, "mail maria@foo-bar.co.uk ﷐ twice maria@foo-bar.co.uk", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"value": F.lit("clash"), "kind": F.lit(1), "n_entities": F.lit("old")})
    got = pii.replaced(df, "key", counts="n_entities").collect()
    assert len(got) == len(rows) and got[0].value == "clash"
    by = {r.doc_id: r for r in got}
    new = by[1].text
    assert new == by[5].text and by[1].n_chars == len(new) and by[2].text is None and by[3].text == "" and by[4].text == rows[3][1] and by[4].n_entities == 0
    m = re.fullmatch(r"Dear (\w+) (\w+), Frau (\w+) and Mr\. (\w+): ([a-z]{5})@([a-z]{3}-[a-z]{3}\.[a-z]{2}\.uk), ([\d.]+), (\+1 \(\d{3}\) \d{3}-\d{4}), (4\d{3} \d{4} \d{4} \d{4}), (\d{3}-\d\d-\d{4}), (DE\d\d(?: \d{4}){4} \d\d), (\w+) (\w+); 4111111111111112, version 1\.2\.3, The The\.", new)
    assert m and m[2] == m[3] != "Schmidt" and m[1] in pii.GIVEN["latin", "female"].split() and m[12] in pii.GIVEN["cyrillic", "male"].split()
    assert all("Ѐ" <= c <= "ӿ" for c in m[13]) and all(0 < int(x) < 256 for x in m[7].split("."))
    digits = [int(c) for c in m[9] if c.isdigit()]
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert by[None].text.count(f"{m[5]}@{m[6]}") == 2 and "﷐" in by[None].text
    assert pii.replaced(df, "other").where("doc_id = 1").first().text != new
    assert pii.replaced(df.limit(0), "key").count() == 0


def test_surrogates_are_distinct_and_never_real(spark):
    values = [f"{a}@b.co" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}{b}@b.co" for a in "abcdefghij" for b in "klmnopqrst"] + [f"10.0.{i}.{j}" for i in range(20) for j in range(20)]
    got = pii.surrogates(spark.createDataFrame([(v,) for v in values], "value string"), "k").collect()
    new = [r.surrogate for r in got]
    assert len(got) == len(values) and len(set(new)) == len(new) and not set(new) & set(values)


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()]
    return sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits, len(digits) % 2)) % 10 == 0


def mod_97(account):
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_surrogates_are_brute_force(spark):
    """Found, mapped and replaced in plain Python."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pattern = regex.compile(pii.PATTERN)
    of = lambda e: next((k for k, p in pii.KINDS.items() if k != "person" and regex.fullmatch(p, e)), "person")
    valid = lambda e: {"card": luhn, "iban": mod_97}.get(of(e), lambda _: True)(e)
    texts = {r.doc_id: r.text for r in docs.collect()}
    values = sorted({m[0] for t in texts.values() for m in pattern.finditer(t or "") if valid(m[0])})
    table = {r.value: r for r in pii.surrogates(spark.createDataFrame([(v,) for v in values], "value string"), "key").collect()}
    assert sorted(table) == values and len(values) > 10 and len({r.surrogate for r in table.values()}) == len(values)
    got = {r.doc_id: (r.text, r.n) for r in pii.replaced(docs, "key", counts="n").collect()}
    for doc_id, text in texts.items():
        count = sum(valid(m[0]) for m in pattern.finditer(text or ""))
        people = [v for m in pattern.finditer(text or "") if (v := m[0]) in table and table[v].kind == "person"]
        names = {p: q for v in people for p, q in zip(v.split(), table[v].surrogate.split(), strict=True) if regex.fullmatch(pii._CAP, p) and p not in pii.TITLES.split()}
        words = set(regex.split(r"[^\p{L}'’-]+", text or ""))
        renamed = lambda s: regex.sub(pii._MENTION, lambda m: m[0] if m[0].lower() in words else names.get(m[0], m[0]), s)  # noqa: B023, E731
        new, last = "", 0
        for m in pattern.finditer(text or ""):
            new, last = new + renamed(text[last : m.start()]) + (table[m[0]].surrogate if valid(m[0]) else m[0]), m.end()
        new = None if text is None else new + renamed(text[last:])
        assert got[doc_id] == (new, count)
    for v, r in table.items():
        assert r.kind == of(v) and r.surrogate not in table and valid(r.surrogate) and len(r.surrogate) == len(v) or r.kind == "person" or r.kind == "ipv4"


def test_entities_of_many_forms(spark):
    rows = {
        "John F. Kennedy met John Quincy Adams.": r"(\w+) [A-Z]\. (\w+) met (\w+) (\w+) (\w+)\.",
        "Siobhan Murphy, Wei Zhang and Aisha Khan": r"(\w+) (\w+), (\w+) (\w+) and (\w+) (\w+)",
        "My name is Tove Ditlevsen, regards, Pádraig von Trier": r"My name is (\w+) (\w+), regards, (\w+) von (\w+)",
        "Call 020 7946 0958 or 06 12 34 56 78 now": r"Call (\d{3} \d{4} \d{4}) or (\d\d(?: \d\d){4}) now",
        "hosts 2001:db8::1 and fe:ab:cd:ef:aa:bb:cc:dd up": r"hosts ([0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]) and ([0-9a-f]{2}(?::[0-9a-f]{2}){7}) up",
        "IBAN GB82 WEST 1234 5698 7654 32 paid": r"IBAN (GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d) paid",
        "Иван Петров и Анна Петрова": "(\\w+) (\\w+ов) и (\\w+) (\\w+ова)",
        "Νικόλαος Παπαδόπουλος": "(\\w+) (\\w+όπουλος)",
    }
    same = ["std::vector a::b", "IBAN DE00 3704 0044 0532 0130 00", "4111111111111112", "Of The The. In Town", "version 1.2.3 at 12:30:45", "New York and Wall Street"]
    df = spark.createDataFrame(list(enumerate([*rows, *same])), "i int, text string")
    got = [r.text for r in pii.replaced(df, "k").orderBy("i").collect()]
    assert got[len(rows) :] == same
    for (old, form), new in zip(rows.items(), got, strict=False):
        a, b = re.fullmatch(form, old), re.fullmatch(form, new)
        assert b and not set(a.groups()) & set(b.groups()), (old, new)
    assert mod_97(got[5][5:-5])
    m = re.fullmatch(list(rows.values())[6], got[6])
    assert m[4] == f"{m[2]}а" and m[1] in pii.GIVEN["cyrillic", "male"].split() and m[3] in pii.GIVEN["cyrillic", "female"].split()


def test_a_person_who_is_found_once_is_replaced_all_over_the_text(spark):
    rows = [
        "Tamika Okafor wrote. Contact Tamika Okafor at noon, or Tamika's dad, or OKAFOR.",
        "Петров Иван и Иван Петров",
        "Contact Rosa Field today. The field is wide, Field said, and Rosa agreed.",
        "Tamika Okafor wrote.",
        "call 07700 900123 or 06 12 34 56 78 or 415 555 2671 or +44 20 7946 0958 or +14155552671",
        "release 1.2.3.4 and version 1.2.3.4, table 300 400 5000 600",
        "Dr. Otis Otisson and Dr. Otisson; Mr. Hu",
    ]
    got = [r.text for r in pii.replaced(spark.createDataFrame(list(enumerate(rows)), "i int, text string"), "k").orderBy("i").collect()]
    m = re.fullmatch(r"(\w+) (\w+) wrote\. Contact (\w+) (\w+) at noon, or (\w+)'s dad, or OKAFOR\.", got[0])
    assert m and m[1] == m[3] == m[5] != "Tamika" and m[2] == m[4] != "Okafor"
    m = re.fullmatch(r"(\w+) (\w+) и (\w+) (\w+)", got[1])
    assert m and m[1] == m[4] != "Петров" and m[2] == m[3] != "Иван"
    m = re.fullmatch(r"Contact (\w+) (\w+) today\. The field is wide, Field said, and (\w+) agreed\.", got[2])
    assert m and m[1] == m[3] != "Rosa" and m[2] != "Field"  # a word of the text too
    assert got[3] == rows[3] and got[5] == rows[5]
    m = re.fullmatch(r"call (07\d{3} \d{6}) or (06(?: \d\d){4}) or (4\d\d \d{3} \d{4}) or (\+44 \d\d \d{4} \d{4}) or (\+1\d{10})", got[4])
    assert m and not set(m.groups()) & set(re.split(" or |call ", rows[4]))
    m = re.fullmatch(r"Dr\. (\w+) (\w+) and Dr\. (\w+); Mr\. (\w+)", got[6])
    assert m and m[2] == m[3] != "Otisson" and m[1] != "Otis"


def test_a_format_that_runs_out_grows(spark):
    values = [f"{a}::{b}" for a in "123456789abcdef" for b in "123456789abcd" if (a + b).strip("abcdef")]
    new = [r.surrogate for r in pii.surrogates(spark.createDataFrame([(v,) for v in values], "value string"), "k").collect()]
    assert len(set(new)) == len(values) and not set(new) & set(values)


def test_very_long_texts_have_all_their_entities_replaced(spark):
    text = "plain words and " * 60_000 + "maria@foo.org " * 2_000
    new, n = pii.replaced(spark.createDataFrame([(text,)], "text string"), "k", counts="n").first()
    assert n == 2_000 and "maria@foo" not in new and len(new) == len(text)


def plain_tokens(text):
    out = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+", text or ""):
        unspaced = any("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" or "\u0e01" <= c <= "\u0e5b" for c in run)
        out += [run] if len(run) <= ordermin.LONGEST and not unspaced else list(run)
    return out


def test_fingerprints_are_those_of_separate_functions(spark):
    """Against a slow version that hashes with Spark but numbers, permutes, selects and orders in Python, each function by itself."""
    texts = ["", "one", "a b a b a b c", "x y z " * 40, " ".join(f"w{i % 13} v{i % 7}" for i in range(300)), "  lead\tand\nbreaks  ", "漢字かな交じり文、漢字 ok สวัสดี", "x" * 60 + " y", " ".join(f"u{i}" for i in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.s for r in ordermin.with_signature(df, "text", "s").collect()}
    hashed = lambda xs, kind: [r[0] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], f"i int, a {kind}, b {kind}").select(F.xxhash64("a", "b").alias("h"), "i").orderBy("i").collect()] if xs else []
    for i, text in enumerate(texts):
        tokens = plain_tokens(text)
        ids = [(h & ordermin._HASH) >> ordermin.POSITION_BITS for h in hashed(list(zip([None, *tokens], tokens)), "string")]  # noqa: B905
        assert len(set(ids)) == len(set(zip([None, *tokens], tokens)))  # noqa: B905
        seen, elements = {}, []
        for x in ids:
            elements.append((x, seen.get(x, 0)))
            seen[x] = seen.get(x, 0) + 1
        again = [r[0] for r in spark.createDataFrame(elements, "a long, b int").coalesce(1).select(F.xxhash64("a", "b")).collect()] if elements else []
        ranks = [x if n == 0 else (h & ordermin._HASH) >> ordermin.POSITION_BITS for (x, n), h in zip(elements, again, strict=True)]
        pairs = []
        for j in range(ordermin.TUPLES if elements else 0):
            two = sorted((r ^ j << 27, at) for at, r in enumerate(ranks))[:2]
            two.sort(key=lambda p: p[1])
            pairs.append((two[0][0], two[1][0] if len(two) > 1 else None))
        assert got[i] == [h & (1 << 32) - 1 for h in hashed(pairs, "long")], text[:20]


def test_likeness_falls_with_edits_in_every_script(spark):
    import random

    rng = random.Random(4)
    scripts = {"words": [f"word{i}" for i in range(3000)], "han": [chr(0x4E00 + i) for i in range(3000)], "thai": [chr(0x0E01 + i) for i in range(46)], "hex": list("0123456789abcdef"), "few": [f"w{i}" for i in range(50)]}
    for name, pool in scripts.items():
        join = " " if name in ("words", "few") else ""
        n = 12 if name == "few" else 300
        base = [rng.choice(pool) for _ in range(n)]
        rows = []
        for share in (0, 5, 15, 33, 66, 100):
            for rep in range(12):
                start = rng.randint(0, n - n * share // 100)
                new = [rng.choice(pool) if start <= k < start + n * share // 100 else c for k, c in enumerate(base)]
                rows.append((share, join.join(base), join.join(new)))
        df = ordermin.with_signature(ordermin.with_signature(spark.createDataFrame(rows, "share int, a string, b string"), "a", "x"), "b", "y")
        near = [r[1] for r in df.groupBy("share").agg(F.avg(ordermin.likeness("x", "y")).alias("n")).orderBy("share").collect()]
        assert near[0] == 1.0 and near[3] > 0.1 and near[5] < 0.25 and all(a > b - 0.02 for a, b in zip(near, near[1:])), (name, near)  # noqa: B905


def test_order_matters_and_likeness_falls_with_edits(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [words, words[200:] + words[:200], words[::-1], words[:380] + ["x"] * 20, [f"z{i}" for i in range(400)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, text string")
    s = ordermin.with_signature(df, "text", "s")
    one = s.where("i = 0").select(F.col("s").alias("a"))
    near = {r.i: r.l for r in s.join(one, how="cross").select("i", ordermin.likeness("a", "s").alias("l")).collect()}
    assert near[0] == 1.0 and near[4] == 0.0 and near[3] > near[1] > near[4] and near[2] < 0.1


@pytest.mark.parametrize("rows_per_range", [2_000, 3])
def test_edited_texts(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(ordermin, "ROWS", rows_per_range)
    texts = {i * i - 5: t for i, t in enumerate(["abc", None, "", "é漢😀xyz words here", "same text of words", "same text of words", "long " * 500, "q", "rr ss", "tt uu vv", "zz"])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"cell": F.lit(1), "signature": F.lit("x"), "range": F.lit(2)})
    got = {r.doc_id: r for r in ordermin.edited(df).collect()}
    order = sorted(texts, reverse=True)
    for k, d in enumerate(order):
        x, y = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(x) // 3
        assert got[d].n_chars == len(x) and got[d].edited_sha256 == hashlib.sha256((x[: len(x) - n] + y[:n]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    same = [got[d].fingerprint for d, t in texts.items() if t == "same text of words"]
    assert same[0] == same[1]


def test_edited_nulls_repeats_and_small_tables(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ordermin.edited(empty).count() == 0
    one = ordermin.edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    monkeypatch.setattr(ordermin, "ROWS", 20)
    same = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate([7] * 900 + [None] * 700 + list(range(100)))], "doc_id long, text string")
    order = sorted(((r.doc_id is None, -(r.doc_id or 0), hashlib.md5(r.text.encode()).hexdigest(), r.text) for r in same.collect()))
    following = {a[3]: b[3] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert {r.text: r.next_text for r in ordermin.neighbours(same).collect()} == following
    ranges = ordermin._ranged(same).groupBy("cell", "range").count().collect()
    assert max(r["count"] for r in ranges) < 170 and len(ranges) > 30  # a doc_id with half the rows is dealt to several ranges
    odd = ordermin.edited(spark.createDataFrame([(None, "x"), (None, None), (3, "y"), (3, "y"), (3, "z")], "doc_id long, text string"))
    assert odd.count() == 5


def test_neighbours_of_ids_that_doubles_cannot_tell(spark, monkeypatch):
    monkeypatch.setattr(ordermin, "ROWS", 10)
    ids = [2**62 + i for i in range(300)] + [-(2**62) - 3 * i for i in range(300)] + [2**62 + 7] * 200 + [-(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string").repartition(5, "text")
    order = sorted((-d, hashlib.md5(f"text {i}".encode()).hexdigest(), f"text {i}") for i, d in enumerate(ids))
    following = {a[2]: b[2] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert {r.text: r.next_text for r in ordermin.neighbours(rows).collect()} == following


def test_pipeline_stages_take_effect(spark):
    """Each stage against a plain version of its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf).persist()
        after = {r.doc_id: r for r in out.collect()} if name != "packing" else {}
        if name == "language":
            assert set(after) == {d for d, r in before.items() if r.text and any(map(str.isalpha, r.text))}
        elif name == "near_duplicates":
            assert len({r.text for r in after.values()}) == len(after) and set(after) <= set(before)
            assert {min(d for d, r in before.items() if r.text == t) for t in {r.text for r in before.values()}} >= set(after)
        elif name == "decontamination":
            block = decontaminate.phrases_of(bench)
            assert not any(s for _, s, _ in decontaminate.find([r.text for r in after.values()], block))
            clean = [d for d, (_, s, _) in zip(before, decontaminate.find([r.text for r in before.values()], block), strict=True) if not s]
            assert all(after[d].text == before[d].text for d in clean)
        elif name == "pii":
            for d, r in before.items():
                old = re.findall(r"[a-z0-9.]+@[a-z0-9.]+\.com|(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.])", r.text)
                assert not any(x in after[d].text for x in old) and (old or re.search(r"\d{3}", r.text) or after[d].text == r.text)
        else:
            assert {r.doc_id for r in out.collect()} == set(before)
            full = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
            assert all(r.n & (r.n - 1) == 0 for r in full)
        assert name == "packing" or out.columns == columns
        docs = out


def test_pipeline_of_nulls_and_empty_tables(spark, tmp_path):
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = whole.limit(30).collect()
    odd = [{**some[0].asDict(), "doc_id": None}, {**some[1].asDict(), "text": None}, {**some[2].asDict(), "text": ""}, {**some[3].asDict(), "lang": None}, some[4].asDict(), some[4].asDict()]
    rows = spark.createDataFrame([*odd, *(r.asDict() for r in some[5:])], whole.schema)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for name, docs, items in (("empty", whole.limit(0), bench), ("plain", rows, bench.limit(0)), ("odd", rows, bench)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = {name: corpus_pipeline.run(spark, f"{tmp_path}/{name}").select("doc_id").distinct().count() for name in ("empty", "plain", "odd")}
    assert got["empty"] == 0 and 0 < got["odd"] <= got["plain"] <= 28
