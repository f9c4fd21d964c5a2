"""Token counts, packing, quality rules, extraction, license scan and sharding against plain versions of them."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import html_extract, license_scan, packing, quality, sharding, token_counts
from trackloom.llm.common import tokenizer_path

LETTERS = list("abc the éñß'sdlvem t.,!?|*0159²½\n\n  \t\r\x0b\x1c\x85\xa0▁　漢ªǅ€—“]^-\\") + ["ing", " the", "  ", "'s", "<s>", "<|endoftext|>", "\r\n"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=rng.randint(0, 25))) for _ in range(n)]


def test_counts_equal_the_library():
    import sentencepiece

    file = tokenizer_path("piece_bpe_32k.model")
    model, lengths = sentencepiece.SentencePieceProcessor(model_file=file), token_counts.PieceLengths(file, {})
    for t in random_texts(4000, 1):
        assert lengths.count(t) == len(model.encode(t)), repr(t)


def test_ids_equal_the_library():
    encoder = packing.Encoder(tokenizer_path("byte_bpe_50k.json"))
    for t in random_texts(4000, 2) + [chr(c) + "a" + chr(c) for c in range(0x250)]:
        assert encoder.encode(t) == encoder.direct(t), repr(t)


def test_token_counts_of_odd_rows(spark, odd, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = sorted(map(tuple, token_counts.count_tokens(odd, limit=3000).collect()))
    want = sorted((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 3000) for r in odd.collect())
    assert got == want
    assert token_counts.count_tokens(none).collect() == []


def test_plan_uses_every_length_once():
    rng = random.Random(4)
    counts = Counter(rng.randint(1, 99) for _ in range(500))
    made = packing.plan(dict(counts), 100)
    used = Counter()
    for lengths, times in made:
        assert sum(k * n for k, n in lengths.items()) <= 100
        for k, n in lengths.items():
            used[k] += n * times
    assert used == counts
    sequences, need = sum(times for _, times in made), sum(k * n for k, n in counts.items()) / 100
    assert sequences <= need * 1.02 + 1


def test_fullest_is_closest_to_the_window():
    counts = {7: 2, 5: 1, 3: 3}
    best = max(a * 7 + b * 5 + c * 3 for a in range(1, 3) for b in range(2) for c in range(4) if a * 7 + b * 5 + c * 3 <= 20)
    assert sum(k * n for k, n in packing.fullest(counts, 20).items()) == best


@pytest.mark.parametrize("window", [64, 2048])
def test_packing_is_an_exact_round_trip(odd, none, window):
    encoder = packing.Encoder(tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(odd, window=window).collect()
    ids = {r.doc_id: np.append(np.frombuffer(encoder.direct(r.text or ""), "<u4"), 1).astype("<u4") for r in odd.collect()}
    times = Counter(r.doc_id for r in odd.collect())
    covered, sequences = Counter(), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == Counter({d: len(x) * times[d] for d, x in ids.items()})
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    assert packing.pack(none).collect() == []


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts():
    rng = random.Random(6)
    texts = random_texts(300, 7) + ["".join(rng.choices(["a ", "b ", "c\n", "d\x0b", "é "], k=60)) for _ in range(300)]
    texts += [" ".join(str(rng.randint(0, 5000)) for _ in range(9000)) + " 1 2 3 4 5 6 1 2 3 4 5 6", None, ""]
    for t in texts:
        assert quality.Document(t).base == base_counts(t)


def test_quality_learns_and_handles_odd_rows(spark, odd, none):
    rng = random.Random(8)
    good = ["the cat and the dog went to the river on a fine day number %d" % rng.randint(0, 99) for _ in range(80)]
    bad = ["buy *** now $$$ click ### here %%%%%% win |||| cash &&&& deal %d" % rng.randint(0, 99) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(160)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    kept = {r.doc_id: r.kept for r in quality.score_quality(docs, model).collect()}
    assert sum(kept[k] == (k < 80) for k in range(160)) >= 156
    got = {(r.doc_id, r.text): r for r in quality.score_quality(odd, model).collect()}
    assert not got[2, None].kept and got[2, None].base_failed and got[2, None].n_words == 0
    assert all(0 <= r.quality_score <= 1 for r in got.values())
    assert quality.score_quality(none, model).collect() == []
    alone = quality.train(docs, labels.where("false"))
    assert quality.score_quality(odd, alone).count() == odd.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies on this site for you.</div>
<article><h1>A  title</h1><p>The first paragraph of the story, with &amp; and &#233; and <b>bold</b>
text that is long enough to be good by itself.<p>Short.</p><div class="ad">Buy this.</div><form>Your name <input></form>
<p>The last paragraph<br>of the story, which is as long as the first one and has the words.</p>
<section class="comments"><p>I liked the story and I am a reader of this site for years.</p></section></article>
<aside><p>Related: the other story of the day that you may like as well.</p></aside><footer>&copy; 2024</footer></body></html>"""


def test_a_text_that_is_too_large_is_passed_over(spark):
    good = ["the cat and the dog went to the river on a fine day number %d" % k for k in range(40)]
    bad = ["buy *** now $$$ click ### here %%%%%% win |||| cash &&&& deal {}".format(k) for k in range(40)]
    texts = [*good, *bad]
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "doc_id long, quality int")
    first = labels.orderBy(F.xxhash64("doc_id")).first().doc_id
    texts[first] *= 2000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert np.count_nonzero(quality.train(docs, labels, sample_bytes=50_000).weights) > 100


def test_own_columns_stay(spark, odd):
    docs = odd.withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns and all(r.kept == "mine" and r.n_words == -1 for r in out.collect())


def test_extraction_of_a_page():
    assert html_extract.main_text(PAGE).split("\n\n") == ["A title", "The first paragraph of the story, with & and é and bold text that is long enough to be good by itself.", "Short.", "The last paragraph of the story, which is as long as the first one and has the words."]


def test_extraction_without_an_article():
    page = "<body><div><a href=a>One</a> <a href=b>Two</a></div><p>The text of the page is in this paragraph and it is for the reader, as it was.</p><p>Yes.</p><p>And this is the rest of the text that the page has for those who read to the end.</p><div class='footer'>Bye</div></body>"
    assert [x[:4] for x in html_extract.main_text(page).split("\n\n")] == ["The ", "Yes.", "And "]


def test_heads_of_pages_and_of_articles():
    page = "<head><title>x</title><body><header><p>The head of the site that is on all of its pages for the reader.</p></header><article><header class='header'><h1>Title of it</h1></header><p>The text of the article is in this paragraph, and it is for the reader to read.</p></article>"
    assert html_extract.main_text(page).split("\n\n") == ["Title of it", "The text of the article is in this paragraph, and it is for the reader to read."]


STORY = ["The text of the page is in this paragraph and it is for the reader of the story, as it was in the paper.", "And this is the rest of the text that the page has for those who read to the end of it.", "It was a day of which the people of the town had much to say, and they did so for years."]
RUSSIAN = ["Весь день над городом шёл тёплый дождь, и люди прятались под крышами старых домов до самого вечера.", "Только к ночи небо прояснилось, и над рекой стал виден яркий месяц, который светил до утра."]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div>{}</div><article><p>Another story of the day that is shown beside this one to the reader.</p></article>", STORY),
        ("<div>{}</div><aside><article><p>A related story of the day that is shown beside this one.</p></article></aside>", STORY),
        ("<div id=page class='site no-sidebar'><div class=nav><a href=a>One</a></div>{}<div class=sidebar>The side of the page that is for the reader of it, as all pages have it.</div></div>", STORY),
        ("<div class='entry share-enabled'>{}</div><footer><p>All of it is by the staff of the site and it is for you.</p></footer>", STORY),
        ("<form id=aspnet>{}<div class=footer>The foot of the page that is on all of the pages of this site.</div></form>", STORY),
        ("<div>{}</div>", RUSSIAN),
        ("<div>{}</div><div class=comments>" + "<p>I have read the story and I am of the view that it is not for me at all.</p>" * 20 + "</div>", STORY),
        ("<nav><a href=a>One</a></nav><main>{}</main><footer>The foot of the page is here and it is long enough to be text by itself.</footer>", STORY),
    ],
)
def test_marks_are_evidence_and_not_verdicts(page, want):
    html = "<html><body>" + page.format("".join(f"<p>{x}</p>" for x in want)) + "</body></html>"
    assert html_extract.main_text(html).split("\n\n") == want


@pytest.mark.parametrize("page", [lambda n: "<div>" * n + "x" + "<i><p>y</b>" * n, lambda n: "<div class=footer><p>x</p>" * n, lambda n: "<aside>" * n + "x" * 90 + "</aside><p>y" * n])
def test_extraction_takes_time_in_proportion(page):
    import time

    took = []
    for n in (4000, 16000):
        began = time.process_time()
        html_extract.main_text(page(n))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


SIDE = "<p>The paragraph number {} of what stands beside the story, for the reader of the page as it was in the paper.</p>"
BESIDE = ["<div class=newsletter>{}</div>", "<div class=sidebar>{}</div>", "<aside>{}</aside>", "<footer>{}</footer>", "<div class='footer wide'>{}</div>", "<div class='box related'>{}</div>"]


@pytest.mark.parametrize("beside", BESIDE)
@pytest.mark.parametrize("n", [1, 5, 6, 30])
@pytest.mark.parametrize("story", ["<article>{}</article>", "<div class=content>{}</div>", "{}"])
@pytest.mark.parametrize("words", [["The only paragraph of the story, and it is for the reader to read and to keep for years."], ["Thtiedly erly anwhan."], ["One.", "Two."]])
def test_short_stories_beside_large_apparatus(beside, n, story, words):
    large = beside.format("".join(SIDE.format(k) for k in range(n)))
    page = story.format("".join(f"<p>{w}</p>" for w in words))
    for html in (page + large, large + page):
        assert html_extract.main_text(html) == "\n\n".join(words)


def test_short_blocks_and_other_scripts():
    assert html_extract.main_text("<nav><a href=x>主页</a></nav><div><p>今天天气很好。</p><p>我们去公园散步。</p></div><footer>版权所有</footer>") == "今天天气很好。\n\n我们去公园散步。"
    assert html_extract.main_text("<a href=x>Home</a><p>Short.</p><p>Shorter.</p>") == "Short.\n\nShorter."
    wrapped = "<p>Home</p><div class='main share-enabled'><h1>A title</h1>" + "".join(SIDE.format(k) for k in range(5)) + "</div><div class=footer>Bye</div>"
    assert html_extract.main_text(wrapped).count("paragraph") == 5


def strip_tags(html):
    """The text of an article element by patterns alone, block by block."""
    import html as entities

    inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", re.sub(r"<br>", " ", inside))
    return "\n\n".join(x for x in (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)


def test_extraction_equals_patterns_on_plain_pages(spark):
    from trackloom.llm import queries
    from trackloom.llm.common import read_table

    sf = "/root/testdata/sf0.1"
    want = {r.page_id: strip_tags(r.html) for r in read_table(spark, sf, "pages").collect()}
    assert {r.page_id: r.text for r in queries.op3_html_extraction(spark, sf).collect()} == want


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<p>a</p", "x"), (4, "u", "<<<>>>&&&", "x"), (5, "u", PAGE, "x"), (5, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id < 3} == {""}
    assert html_extract.extract(pages.where("false")).collect() == []


def scanned(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    places, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, odd, none):
    rng = random.Random(9)
    parts = ["MIT License", "mit", "license", "Apache", "apache-license", "GNU General Public License v3", "general public license", "under the", "x", "é", "K", "MIT  License,", "copyright (c) 2020", "SPDX-License-Identifier: MIT", "\n", "licensed under Apache 2.0"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scanned(r.text), r.text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert {r.doc_id: r.n_words for r in license_scan.scan(odd).collect()} == {r.doc_id: scanned(r.text)[0] for r in odd.collect()}
    assert license_scan.scan(none).collect() == []


def test_license_rules_suppress_what_lies_inside(spark):
    rows = [(1, "Licensed under the GNU General Public License v3."), (2, "Released under the MIT license."), (3, "nothing here")]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "gpl,gpl-3.0", 2: "mit", 3: ""}


def test_license_anchors_are_in_every_name():
    rules = license_scan.rules()
    assert len(rules) > 250 and all(near for _, _, near, _, _, _ in rules)
    for label, text in [("apache-2.0", "apache license version 2 0"), ("bsd-2-clause", "simplified bsd"), ("cc-by-sa", "cc by sa 4 0"), ("mpl-2.0", "mozilla public license 2 0")]:
        name = next(n for family, n in license_scan.FAMILIES if family == label)
        assert re.fullmatch(name, text) and set(text.split()) & set(license_scan.anchors(name))


def test_every_spelling_of_a_license_name_holds_an_anchor(spark):
    for _, name in license_scan.FAMILIES:
        near = set(license_scan.anchors(name))
        for text in license_scan.spellings(name):
            assert re.fullmatch(name, text) and (not near or near & set(text.split())), text
    names = ["GPLv2", "GPL2", "GPLv3", "LGPLv3", "AGPLv3", "GPLv1", "LGPLv2"]
    docs = spark.createDataFrame([(n, f"This code is licensed under the {n}") for n in names], "doc_id string, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert got == {"GPLv2": "gpl-2.0", "GPL2": "gpl-2.0", "GPLv3": "gpl-3.0", "LGPLv3": "lgpl-3.0", "AGPLv3": "agpl-3.0", "GPLv1": "gpl-1.0", "LGPLv2": "lgpl-2.0"}


def test_each_license_rule_is_found_by_its_match_alone(spark):
    odd_word = lambda p: re.sub(r"\(\?: \[0-9\]\{4\}\)\*|\(\?: \[\^ \]\+\)\{0,6\}", "", p).replace("[0-9]{4}", "2020")
    docs = []
    for rank, keywords, near, pattern, label, _ in license_scan.rules():
        some = license_scan.spellings(odd_word(pattern.removeprefix("(?<= )").removesuffix("(?= )")))
        if rank < len(license_scan.BASE) + len(license_scan.NOTICES):  # a match holds the keyword, so the rule is tried
            assert all(set(x.split()) & set(keywords) and set(x.split()) & set(near) for x in some), (label, pattern)
        docs += [(rank, label, x, f"x {x} y") for x in {some[0], some[-1], min(some, key=len), max(some, key=len)}]
    docs += [(-1, "mit", "", "Released\nunder MIT"), (-1, "mpl-2.0", "", "distributed under the terms of the MPL 2.0"), (-1, "cc-by", "", "available under CC BY 4.0"), (-1, "bsd", "", "published under BSD"), (-1, "cc0", "", "CC-0")]
    table = spark.createDataFrame(docs, "rank int, label string, spelling string, text string")
    laid = table.select("rank", "label", "text", license_scan.worth_laying(F.lower("text")).alias("laid")).collect()
    assert all(r.laid for r in laid), [r.text for r in laid if not r.laid]
    own = [d for d in docs if d[0] < 0] + [(0, "bsd-3-clause", "", "may be used to endorse or promote products derived from this software")]
    got = license_scan.scan(spark.createDataFrame(own, table.schema)).collect()
    assert all(r.labels == r.label and r.score > 0 for r in got), got


def test_sharding(spark, odd, none):
    docs = spark.createDataFrame([(k, None if k % 50 == 0 else f"text {k % 7} " * (k % 30)) for k in range(2000)], "doc_id long, text string")
    rows = sharding.shard(docs, bucket_bytes=2000).collect()
    assert len(rows) == 2000
    slots = defaultdict(list)
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.slot) if r.shard == 0]
    assert order != sorted(order)
    again = {r.doc_id: r.shard for r in sharding.shard(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.shard for r in rows}
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(none).collect() == []


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("hot_id", [7, None])
def test_a_hot_key_is_dealt_over_buckets(spark, monkeypatch, same, hot_id):
    """A third of all records with one id, of different texts or of one: no bucket may hold more than a small part."""
    texts = ["t" * 20 if same else f"text {k}" for k in range(2000)]
    docs = spark.createDataFrame([(hot_id, t) for t in texts] + [(100 + k, f"other {k}") for k in range(4000)], "doc_id long, text string").repartition(5)
    seen, array_sort = [], F.array_sort
    monkeypatch.setattr(sharding.F, "shuffle", lambda records, s: seen.append(1) or array_sort(records))
    places = sharding.shard(docs, bucket_bytes=100, shards=2).select("doc_id", "text", "shard", "slot").collect()
    assert seen and sorted(r.text for r in places if r.doc_id == hot_id) == sorted(texts)
    assert len({r.shard for r in places if r.doc_id == hot_id}) == 1
    for k in range(2):
        assert sorted(r.slot for r in places if r.shard == k) == list(range(sum(r.shard == k for r in places)))
    # unshuffled, a bucket's records lie in the order of their ids, so a bucket holds a run of hot ones at most
    longest = run = 0
    for r in sorted((r for r in places if r.shard == next(x.shard for x in places if x.doc_id == hot_id)), key=lambda r: r.slot):
        run = run + 1 if r.doc_id == hot_id else 0
        longest = max(longest, run)
    assert longest < 200


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
