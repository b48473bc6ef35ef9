from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
import zstandard

from sightline.llm import decontaminate, language_id, license_scan, url_filter

from .conftest import prose


def test_language_id_on_held_out_rows(spark):
    words = {"en": "the and of to in is that for with this from have not they which".split(), "de": "der die und das ist nicht mit sich auf für ein eine dem den".split(), "fr": "le la les des est une dans que pour qui sur avec pas plus".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(8, 80))), lang) for i, lang in enumerate(["en", "de", "fr"] * 120)]
    rows += [(1000, None, "en"), (1001, "123 ½² !!", "de"), (1002, "", None), (None, "the and of", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    model = language_id.train(docs.filter(~language_id.held_out() & docs.doc_id.isNotNull()))
    assert sorted(model) == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).withColumn("held_out", language_id.held_out()).collect()}
    assert len(got) == len(rows) and all(r["held_out"] == held(d) for d, r in got.items())
    judged = [(d, lang) for d, _, lang in rows[:360] if held(d)]
    assert sum(got[d]["lang_pred"] == lang for d, lang in judged) >= 0.95 * len(judged)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for d in (1000, 1001, 1002):
        assert (got[d]["lang_pred"], got[d]["score"], got[d]["rejected"]) == ("und", 0.0, True)
    kept = language_id.relabel(docs, model).collect()
    assert {r["doc_id"] for r in kept} == {d for d, r in got.items() if not r["rejected"]} and all(r["lang"] == got[r["doc_id"]]["lang_pred"] for r in kept)


def test_language_id_learns_every_label(spark):
    rng = random.Random(4)
    words = {f"l{n:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for n in range(140)}
    rows = [(10 * n + i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for n, k in enumerate(words) for i in range(5 if n < 130 else 3)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model) == sorted(words) and max(map(len, model.values())) <= language_id.DICT_BYTES * 128 // 140
    judge = language_id.Classifier(model)
    assert all(judge(" ".join(rng.choice(ws) for _ in range(30)))[0] == k for k, ws in words.items())


def slow_language(text, dictionaries):
    """Sizes by the library's plain calls: one compressor a dictionary and block, no shared state."""
    letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode() if text else b""
    if not letters:
        return "und", 0.0
    raw = b" ".join([letters] * 6) if len(letters) < 128 else letters
    sizes = {}
    for name, held in sorted(dictionaries.items()):
        own = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, **language_id.SEARCH)
        own.precompute_compress(compression_params=params)
        sizes[name] = sum(len(zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
    best = min(sizes, key=lambda k: (sizes[k], k))
    return best, 1 / sum(math.exp((sizes[best] - v) / 4.0) for v in sizes.values())


def test_language_id_equals_brute_force_on_strange_rows(spark, no_docs):
    """Nulls, ties, repeated rows, very long texts, clashing columns."""
    rng = random.Random(3)
    words = {"aa": "bala kolo mitu".split(), "bb": "strand felsig haus".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    dictionaries = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rows += [(100, "bala " * 30_000, None), (101, "q", "aa"), (102, "Ω≈ç 12 __ x", "bb"), (103, None, "aa"), (104, "٣٤ ½", None), (105, "", "bb"), rows[0], (None, rows[1][1], None), (106, "Kolo-Haus", "zz")]
    df = spark.createDataFrame([(d, t, k, "score", 1) for d, t, k in rows], "doc_id long, text string, lang string, lang_pred string, score int").repartition(2)
    got = language_id.identify(df, dictionaries).collect()
    assert len(got) == len(rows)
    want = {d: slow_language(t, dictionaries) for d, t, _ in rows}
    for r in got:
        name, score = want[r["doc_id"]]
        assert (r["lang_pred"], r["rejected"]) == (name, score < language_id.ACCEPT) and abs(r["score"] - score) < 1e-12
    twins = {"one": dictionaries["aa"], "two": dictionaries["aa"]}  # a tie goes to the first and is worth a half
    assert language_id.Classifier(twins)("bala kolo mitu bala")[:2] == ("one", 0.5)


def test_language_id_without_anything_learned(spark, no_docs):
    assert language_id.train(no_docs) == {}
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert language_id.identify(one, {}).first()["lang_pred"] == "und"
    assert language_id.identify(no_docs, {}).collect() == []


LICENSES = [
    None, "", "MIT License", "the mit  license, MIT-license; apache license GNU General Public License v3", "cc-by 4.0 and CC BY-NC 4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    license_scan._MIT + " x " + license_scan._APACHE.upper(), license_scan._BSD + license_scan._BSD3 + license_scan._BSD_END, license_scan._GNU.format("Lesser", "3"),
    "permission is hereby granted free of charge", "gnu general public", "Licensed under the Apache License, Version 2.0.", "mit license " * 300, "cc by", "überlicense mité license", "BSD License. mozilla public license",
]


def test_license_scan_equals_sql(spark, no_docs):
    rows = list(enumerate(LICENSES)) + [(2, LICENSES[2]), (None, "apache license")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string")
    got = sorted(map(str, license_scan.scan_licenses(docs).toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)))
    con = duckdb.connect()
    con.register("documents_arrow", docs.toArrow())
    con.execute("create view documents as select * from documents_arrow")
    want = sorted(map(str, con.execute(license_scan.ORACLE).fetchall()))
    fix = lambda rs: sorted(tuple("None" if v in ("None", "nan") else v.removesuffix(".0") for v in r.strip("()").replace("'", "").split(", ")) for r in rs)
    assert fix(got) == fix(want)
    assert sorted(map(str, license_scan.scan_licenses(docs, top=1).collect())) == sorted(map(str, license_scan.scan_licenses(docs).collect()))  # anchors are always looked up
    told = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert told[3]["base_labels"] == "apache,gpl,mit" and told[3]["n_base"] == 4 and told[12]["n_base"] == 300 and told[12]["last_word"] == 598
    assert told[6]["labels"] == "apache,apache-2.0,mit" and told[6]["score"] == 1.0 and told[7]["labels"] == "bsd,bsd-3-clause" and told[8]["labels"] == "lgpl"
    assert told[11]["labels"] == "apache,apache-2.0" and told[4]["labels"] == "cc-by,cc-by-nc" and told[5]["labels"] == "mit" and told[5]["base_labels"] == ""
    assert license_scan.scan_licenses(no_docs).collect() == []
    text = Path(license_scan.__file__).read_text()
    assert not any(w in text for w in ("pandas", "mapIn", "udf", "rdd"))


URLS = [None, "", "no scheme", "http://a.org/x", "http://ORG/", "http://sub.example.org/es/1", "http://example.org/en/12", "http://example.org/fr", "http://x.com/fr/a?b", "http://com/de/", "http://y.com", "https://notorg/x", "http://a.org:80/x", "http://a.org?/es/", "http://free-casino.net/win", "http://freecasino.net/win"]


def slow_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), name, told) for told, h, p, name in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "<p>free casino win</p>") for i, u in enumerate(URLS)] + [(None, URLS[3], None)], "page_id long, url string, html string")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule = slow_rule(URLS[r["page_id"]] if r["page_id"] is not None else URLS[3])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        assert r["verdict"] == (rule[1] if rule else r["verdict"]) and r["verdict"] in ("allow", "block")
    words = {r["page_id"]: r["words"] for r in got}
    assert words[15][:2] == ["h:free", "h:casino"]
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_url_bayes_learns_from_ruled_rows(spark):
    rules = [("allow", "good.net", "/", "good.net/"), ("block", "bad.net", "/", "bad.net/")]
    rows = [(i, f"http://x{i % 7}.good.net/garden/{i}") for i in range(60)] + [(100 + i, f"http://y{i % 7}.bad.net/casino/{i}") for i in range(40)] + [(200, "http://z.info/casino/1"), (201, "http://z.info/garden/1")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[200] == "block" and got[201] == "allow"


def test_url_models_keep_every_word(spark):
    """Words beyond the 50,000 most frequent split hosts and weigh in the verdict as well."""
    letter = "abcdefghijklmnopqrst"
    many = ["".join(letter[n // 20**k % 20] for k in range(4)) + "u" for n in range(60_000)]
    rules = [("allow", "good.net", "/", "good.net/"), ("block", "bad.net", "/", "bad.net/")]
    rows = [(i, f"http://good.net/{'/'.join(many[i::60])}", " ".join(many[i::60])) for i in range(60)]
    rows += [(100, "http://bad.net/wolf", "wolf lamb"), (200, "http://wolflamb.info/x", None), (201, "http://z.info/wolf", None), (202, "http://z.info/x", None)]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got[200]["words"][:2] == ["h:wolf", "h:lamb"]
    assert got[201]["p_block"] > 1.5 * got[202]["p_block"]


def slow_split(run, counts, total):
    """Every split's cost by plain dynamic programming over all words."""
    cost = lambda w: -math.log(counts[w] / total) if w in counts else math.log(total) + len(w) * math.log(10)
    best = [(0.0, ())]
    for i in range(1, len(run) + 1):
        best.append(min((best[j][0] + cost(run[j:i]), best[j][1] + (run[j:i],)) for j in range(i)))
    return best[-1]


def slow_filter(pages, rules):
    """The whole filter by loops: unigrams, segmentation, Bayes."""
    counts = Counter()
    for _, url, html in pages:
        _, path, _ = slow_rule(url)
        counts.update(re.findall("[a-z]+", path.lower()))
        counts.update(re.findall("[a-z]+", re.sub("<[^>]*>", " ", html or "").lower()))
    total, tokens, told = sum(counts.values()), [], []
    for _, url, _ in pages:
        host, path, rule = slow_rule(url)
        own = []
        for mark, text in (("h:", host), ("p:", path.lower())):
            for run in re.findall(r"[a-z]+|[0-9]+|[^\W\d_a-z]+", text):
                own += [mark + w for w in (("#",) if run[0].isdigit() else slow_split(run, counts, total)[1])]
        tokens.append(own)
        told.append(rule and rule[1])
    seen = {v: Counter(w for ws, t in zip(tokens, told) if t == v for w in ws) for v in ("allow", "block")}
    words = set(seen["allow"]) | set(seen["block"])
    n = {v: sum(c.values()) for v, c in seen.items()}
    out = {}
    for (page, url, _), own, verdict in zip(pages, tokens, told):
        odds = math.log(told.count("block") / told.count("allow"))
        for w in own:
            if w in words:
                odds += math.log((seen["block"][w] + 1) / (n["block"] + len(words) + 1)) - math.log((seen["allow"][w] + 1) / (n["allow"] + len(words) + 1))
        out[page] = (verdict or ("block" if odds > 0 else "allow"), 1 / (1 + math.exp(-odds)), own)
    return out


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["free", "casino", "garden", "news", "shop", "online", "win", "tree", "river", "de", "a", "x" * 30]
    glue = lambda k: "".join(rng.choice(vocabulary) for _ in range(k))
    urls = [None, "", "nothing", "http://com/de/", "http://e.com/fr/x" + "y" * 3000, "http://ORG/Ünï/7"]
    urls += [f"http://{glue(2)}.{rng.choice(['org', 'com', 'info', 'example.org'])}/{rng.choice(['de', 'fr', 'es', 'x'])}/{glue(rng.randrange(1, 4))}/{rng.randrange(99)}" for _ in range(70)]
    pages = [(i, u, f"<p>{' '.join(rng.choice(vocabulary) for _ in range(12))}</p>") for i, u in enumerate(urls)]
    rows = pages + [pages[9]]
    df = spark.createDataFrame([(*p, "h", 1.0) for p in rows], "page_id long, url string, html string, host string, weight double").repartition(3)
    got = url_filter.filter_urls(df).collect()
    want = slow_filter(rows, url_filter.RULES)
    assert len(got) == len(rows)
    for r in got:
        verdict, p, words = want[r["page_id"]]
        assert (r["verdict"], r["words"]) == (verdict, words) and abs(r["p_block"] - p) < 1e-9
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_a_very_long_run_is_split_in_time():
    cut = url_filter.Segmenter({"free": 50, "casino": 40, "a": 5, "e" * 40: 2})
    assert cut.split("free" + "z" * 20_000 + "e" * 40) == ("free", "z" * 20_000, "e" * 40)
    for run in ("freecasino", "afreeze", "casinocasinoa", "zzfreezz", "e" * 50):
        counts = {"free": 50, "casino": 40, "a": 5, "e" * 40: 2}
        cost = lambda ws: sum(-math.log(counts[w] / 97) if w in counts else math.log(97) + len(w) * math.log(10) for w in ws)
        assert abs(cost(cut.split(run)) - slow_split(run, counts, 97)[0]) < 1e-9


def test_segmenter_prefers_known_words():
    cut = url_filter.Segmenter({"free": 50, "casino": 40, "online": 30, "a": 5})
    assert cut.split("freecasinoonline") == ("free", "casino", "online")
    assert cut.split("zzzqqq") == ("zzzqqq",)


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(0)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (25, 60))
        told = decontaminate.myers(p, t, len(p))
        assert (told[0] if told else len(p)) == edits(p, t)


def test_decontamination_equals_brute_force(spark, no_docs):
    items = [(i, prose(900 + i, 18)) for i in range(6)] + [(6, None), (7, "short"), (8, prose(900, 18))]
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = prose(2000 + i, 30)
        if i % 3 == 0:
            own = list(items[i % 6][1])
            for _ in range(rng.randrange(0, 12)):
                own[rng.randrange(len(own))] = rng.choice("qxz ")
            text = prose(3000 + i, 10) + ", " + "".join(own).upper() + "! " + prose(4000 + i, 10)
        rows.append((i, text))
    rows += [(60, None), (61, ""), (62, items[1][1]), (62, items[1][1]), (None, items[2][1]), (63, "a" * 30_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in rows:
        for i, item in items:
            c = decontaminate.clean(item)
            if len(c) >= decontaminate.MIN_CHARS and t and len(t) < 20_000:
                n = edits(c, decontaminate.clean(t))
                if n <= int(decontaminate.ERRORS * len(c)):
                    want[d, i] = n
    for size in (2_000_000, 500):  # in one slice and in several
        got = decontaminate.contaminated(docs, bench, slice_chars=size).collect()
        assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == want and len(want) > 15
        assert len(got) == len(want) + 1  # the repeated row
    assert decontaminate.contaminated(no_docs, bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []


def test_short_items_and_null_ids_are_found(spark):
    items = [(1, "What is 7 x 8?"), (2, "今天天气怎么样？"), (3, "..."), (None, prose(905, 18)), (None, "Who ran?")]
    rows = [(1, "He asked: what is 7 x 8? No"), (2, "He asked what is 7 x 88"), (3, "somewhat is 7 x 8"), (4, "他问我今天天气怎么样，然后走了。"), (5, "…" + prose(905, 18)), (6, "Who ran"), (7, "who ran2"), (8, "...")]
    rows += [(9, "somewhat is 7 x 8, what is 7 x 8")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (2_000_000, 100):
        got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated(docs, bench, slice_chars=size).collect()}
        assert got == {(1, 1, 0), (4, 2, 0), (5, None, 0), (6, None, 0), (9, 1, 0)}
    hit = decontaminate.contaminated(docs.filter("doc_id = 9"), bench).first()
    assert decontaminate.clean(rows[8][1])[hit["start"] : hit["end"]] == "what is 7 x 8" and hit["start"] > 4


@pytest.mark.parametrize("errors", [0.0, 0.06, 0.3])
def test_pieces_cover_an_item(errors):
    item = "the quick brown fox jumps over the lazy dog again and again"
    told = decontaminate.pieces(item, errors)
    assert "".join(p for _, p in told) == item and len(told) == int(errors * len(item)) + 1


@pytest.mark.parametrize("errors", [0.04, 0.12, 0.3])
def test_growing_ranges_lose_no_passage(errors):
    rng = random.Random(int(errors * 100))
    items = [(n, "".join(rng.choice("abcd ") for _ in range(rng.randrange(24, 90))).strip().ljust(24, "e")) for n in range(40)]
    match, found = decontaminate.Matcher(items, errors), 0
    for _ in range(200):
        n, item = rng.choice(items)
        own = list(item)
        for _ in range(rng.randrange(int(errors * len(item)) + 3)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = rng.choice(["", "x", "a", "bc"])
        text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(40))) + "".join(own) + "".join(rng.choice("abcd ") for _ in range(rng.randrange(40)))
        want = {i: e for i, t in items if (e := edits(t, text)) <= int(errors * len(t))}
        assert {i: e for i, e, *_ in match(text)} == want
        found += len(want)
    assert found > 60


def test_one_replaced_word_is_found_in_the_shortest_benchmark_item():
    rng = random.Random(4)
    items = [(n, decontaminate.clean(prose(950 + n, 30))[:80].strip().ljust(80, "e")) for n in range(30)]
    words = [w for _, t in items for w in t.split() if len(w) <= 9]
    match = decontaminate.Matcher(items)
    for n, item in items:
        own = item.split()
        own[rng.choice([i for i, w in enumerate(own) if len(w) <= 9])] = rng.choice(words)
        assert n in {i for i, *_ in match(f"so {' '.join(own)} it says")}
