from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import byte_bpe, html_extract, language_id, mixing, quality_rules, sharding
from shelfmark.llm.queries import codec
from tests.llm.rows import AWKWARD, LONG, PROSE, collected, docs_of, empty_of


def tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_library():
    own, theirs = codec(), tokenizer()
    texts = [r[1] or "" for r in AWKWARD] + [
        "I'll we've don't  \n\n x", "<|endoftext|>", "a" * 3000, "สวัสดี" * 50, "=" * 999, "\r\n\t \v",
    ]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_perfect_hash_is_minimal():
    own = codec()
    at = own.index.candidates(list(own.whole))
    assert at.tolist() == list(range(len(own.whole)))
    assert sorted(own.index.at.tolist()) == list(range(len(own.whole)))


def test_round_trip_rows(spark):
    theirs = tokenizer()
    wanted = []
    for doc_id, text, *_ in AWKWARD:
        ids = theirs.encode_ordinary(text or "")
        sha = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        wanted.append((doc_id, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    found = byte_bpe.round_trip(docs_of(spark), codec())
    assert collected(found) == sorted(wanted, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert dict(found.dtypes)["doc_id"] == "bigint"
    assert byte_bpe.round_trip(empty_of(docs_of(spark)), codec()).count() == 0


def test_encoded_and_decoded_columns(spark):
    docs = docs_of(spark).drop("ids", "bytes")
    back = byte_bpe.decoded(byte_bpe.encoded(docs, codec()), codec())
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r[1] or "").encode() for r in AWKWARD)
    rows = byte_bpe.token_rows(docs_of(spark), codec())
    assert rows.filter("n_tokens <> size(ids)").count() == 0 and "text" not in rows.columns


def test_token_rows_tell_wrong_ids(spark):
    import corpus_pipeline

    docs = docs_of(spark, [r for r in AWKWARD if r[0] in (None, 2, 3, 4, 10)])
    assert {r.intact for r in corpus_pipeline.tokens(spark, docs, "").collect()} == {True}
    wrong = codec()
    wrong.tokens[wrong.encode(["\U0001f600"])[0].tolist()[0]] = b"?"
    found = byte_bpe.token_rows(docs, wrong).collect()
    assert {r.doc_id for r in found if not r.intact} == {10} and len(found) == docs.count()


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_base_measures_match_brute_force(spark):
    rows = AWKWARD + [
        (20, "a b c d e f a b c d e f a b c d e", "en", "q", 1), (21, "x\nx\n\nx\n y\n#|<", "en", "q", 1),
        (22, "z " * 50, "en", "q", 1),
    ]
    found = quality_rules.verdicts(docs_of(spark, rows))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    wanted = [(r[0], *brute_measures(r[1])) for r in rows]
    assert collected(found, *columns) == sorted(wanted, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert quality_rules.verdicts(empty_of(docs_of(spark))).count() == 0


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    notice = "this line of a notice is on every page of the host that we look at here today"
    rows = [(i, f"{notice.upper() if i % 2 else notice}\nown text number {i} " + " ".join(f"w{i}x{k}" for k in range(30)), "en", "h", 0) for i in range(60)]
    rows += [(100, notice + "\nfew words", "en", "h", 0), (101, notice + "\nfew words", "en", "other", 0)]
    rows += [(200 + i, PROSE, "en", "h", 0) for i in range(80)]
    docs = docs_of(spark, rows)
    found = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    assert all(found[i].kept and found[i].n_frequent_lines == 1 for i in range(60))
    assert not found[100].kept and not found[100].base_failed
    assert found[101].kept and found[101].n_frequent_lines == 0
    # Copies of a text count once, so their line is no boilerplate.
    assert all(found[200 + i].kept for i in range(80))
    clean = quality_rules.without_frequent_lines(docs)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and len(texts) == len(rows)
    assert texts[100] == "few words" and texts[3].startswith("own text number 3 ") and texts[101] == rows[61][1]


def test_line_limits_fire_on_small_hosts_and_copies_do_not_move_them(spark):
    notice = "this line of a notice is on every page of the host that we look at here today"

    def own(i):
        return notice + f"\nown text number {i} " + " ".join(f"w{i}x{k}" for k in range(20))

    rows = [(i, own(i), "en", "small", 0) for i in range(20)] + [(50, notice + "\nfew words", "en", "small", 0)]
    rows += [(100 + i, own(i), "en", None, 0) for i in range(6)] + [(200 + i, own(i), "en", "five", 0) for i in range(5)]
    found = {r.doc_id: r for r in quality_rules.verdicts(docs_of(spark, rows)).collect()}
    assert all(found[i].n_frequent_lines == 1 for i in [*range(20), 50, *range(100, 106)])
    assert all(found[200 + i].n_frequent_lines == 0 for i in range(5)) and not found[50].kept
    copies = [(1000 + i, PROSE, "en", "small", 0) for i in range(7000)]
    more = {r.doc_id: r for r in quality_rules.verdicts(docs_of(spark, rows + copies, clashes=False)).collect()}
    assert all(more[i] == found[i] for i in found) and all(more[c[0]].kept for c in copies)
    assert quality_rules.without_frequent_lines(empty_of(docs_of(spark))).count() == 0
    texts = {r.doc_id: r.text for r in quality_rules.without_frequent_lines(docs_of(spark, rows)).collect()}
    assert not texts[103].startswith(notice) and texts[203].startswith(notice)


def language_rows():
    words = {"aa": "balo miru santo kelim", "bb": "zrek tvost grund pfalz", "cc": "ouvre cheaux dellez parque"}
    return [
        (i, " ".join(f"{w}{'' if (i + k) % 3 else 'e'}" for k, w in enumerate(words[lang].split() * 5)), lang, "s", 0)
        for i, lang in enumerate(list(words) * 60)
    ]


def test_languages_of_held_out_rows(spark):
    found = language_id.languages_of(docs_of(spark, language_rows())).collect()
    lang = {r[0]: r[2] for r in language_rows()}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred == lang[r.doc_id] and 0 <= r.score <= 1
    assert any(r.held_out for r in found)


@pytest.mark.parametrize("sample_docs", [1, 7, 100, 10_000])
def test_sample_has_the_smallest_checksums_of_each_language(spark, sample_docs):
    rows = [(i, f"text {i % 900}", "abc"[min(i % 7, 2)], "s", 0) for i in range(2000)] + [(None, f"x {i}", "a", "s", 0) for i in range(50)]
    rows += [(5, "text 5", "c", "s", 0)] * 100
    docs = docs_of(spark, rows)
    found = Counter((r.in_id, r.in_key) for r in language_id.sampled(docs, sample_docs).collect())
    key = F.xxhash64("text")
    told = docs.select("lang", "doc_id", key.alias("k"), F.shiftrightunsigned(F.xxhash64("doc_id", key), 32).alias("s")).collect()
    wanted = set()
    for lang in "abc":
        own = sorted({(r.s, -1 if r.doc_id is None else r.doc_id, r.k) for r in told if r.lang == lang})
        wanted |= {(None if d == -1 else d, k) for _, d, k in own[:sample_docs]}
    repeated = sample_docs < 10_000  # repeats of a row can only shorten the sample
    assert set(found) <= wanted if repeated else set(found) == wanted
    assert max(found.values()) == 1 and len(found) >= min(len(wanted), 3 * sample_docs) - 100


def brute_language(rows, text, most_words, most_grams):
    """Scores by plain counting: known words by their frequency, others by their longest known n-grams."""
    words, grams = defaultdict(Counter), {n: defaultdict(Counter) for n in (4, 3, 2, 1)}
    for _, t, lang, *_ in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            words[lang][w] += 1
    langs = sorted(words)

    def tables(counts, most, full=None):
        kept = {x: dict(sorted(counts[x].items(), key=lambda kv: (-kv[1], kv[0]))[:most]) for x in langs}
        items = set().union(*kept.values())
        totals = {x: max(sum((full or kept)[x].values()), 1) for x in langs}
        return {i: [math.log((kept[x].get(i, 0) + 0.5) / (totals[x] + 0.5 * len(items))) for x in langs] for i in items}

    for lang in langs:
        for w, n in words[lang].items():
            marked = f"\x02{w}\x03"
            for k in grams:
                for i in range(len(marked) - k + 1):
                    grams[k][lang][marked[i:i + k]] += n
    known = tables(words, most_words, words)
    logs = {k: tables(grams[k], most_grams) for k in grams}
    sums = [0.0] * len(langs)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        scores = known.get(w)
        marked = f"\x02{w}\x03"
        for k in grams:
            if scores is None:
                hits = [logs[k][g] for g in (marked[i:i + k] for i in range(len(marked) - k + 1)) if g in logs[k]]
                scores = [sum(c) / len(hits) for c in zip(*hits, strict=True)] if hits else None
        sums = [a + b for a, b in zip(sums, scores or [0.0] * len(langs), strict=True)]
    shares = [math.exp(x - max(sums)) for x in sums]
    return langs[sums.index(max(sums))], max(shares) / sum(shares)


def test_scores_match_brute_force(spark):
    fitted = [r for r in language_rows() if zlib.crc32(str(r[0]).encode()) % 5]
    texts = ["balo miru", "zrekgrund tvost xx", "ouvre cheauxparque dellez", "kelimo granto", "qqq", "santo ouvre pfalz pfalz balomi", "balo grund"]
    for kept in (3, 20_000):
        model = language_id.trained(docs_of(spark, language_rows()), kept_words=kept, kept_grams=4 * kept)
        for text, lang, score in zip(texts, *model.predict(texts), strict=True):
            wanted = brute_language(fitted, text, kept, 4 * kept)
            assert score == pytest.approx(wanted[1]) and (lang == wanted[0] or score < 0.51)


def test_language_of_awkward_texts(spark):
    model = language_id.trained(docs_of(spark, language_rows()))
    found = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.predicted(docs_of(spark), model).collect()}
    for doc_id, text, *_ in AWKWARD:
        lang, score = found[doc_id, text]
        assert (lang == "und") == (not re.search(r"[^\W\d_]", text or "")) and 0 <= score <= 1
    # An unseen word goes by its n-grams.
    assert model.predict(["zrekgrund"])[0] == ["bb"] and model.predict(["cheauxparque"])[0] == ["cc"]
    untrained = language_id.trained(empty_of(docs_of(spark)))
    assert untrained.predict(["text"]) == (["und"], [0.0])
    assert language_id.predicted(empty_of(docs_of(spark)), model).count() == 0
    kept = language_id.drop_unknown(docs_of(spark, AWKWARD + language_rows()))
    assert kept.columns == docs_of(spark).columns
    assert kept.count() == len(language_rows()) + sum(bool(re.search(r"[^\W\d_]", r[1] or "")) for r in AWKWARD)


PAGES = {
    "plain": ("<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>One  two&amp;\n three"
              "<p><b>Bold</b> text<br>more</article><footer>&copy; foot</footer>", "Head\n\nOne two& three\n\nBold text more"),
    "aside in article": ("<article><p>Body text stands here.</p><aside>side note</aside><div class='comments'><p>great post, I agree with "
                         "all of it and more</p></div><form>name <input></form><p>Last words.</p></article>",
                         "Body text stands here.\n\nLast words."),
    "script": ("<article><p>a</p><script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>b</p></article>", "a\n\nb"),
    "cookie": ("<body><div id='cookie-notice'>We use cookies on this site, please accept all of them now.</div><main><p>Real text of "
               "the page.</p></main></body>", "Real text of the page."),
    "cut off": ("<article><p>The start of it</p><p>and the rest &am", "The start of it\n\nand the rest &am"),
    "no article": ("<div><p>" + "Long paragraph with many plain words in it. " * 8 + "</p><p>" + "Another long paragraph follows here. " * 8
                   + "</p></div><ul><li><a href=1>one</a><li><a href=2>two</a></ul>",
                   ("Long paragraph with many plain words in it. " * 8).strip() + "\n\n" + ("Another long paragraph follows here. " * 8).strip()),
    "quotes": ("<article><p title='a > b' class=\"lead\">x &lt;y&gt; &#233;&eacute;&#x1F600;</p></article>", "x <y> éé\U0001f600"),
    "empty": ("", ""), "only markup": ("<article></article>", ""), "stray": ("<article><p>1 < 2 and a <b>c</article>", "1 < 2 and a c"),
}


@pytest.mark.parametrize("page, wanted", [
    ("<html><head><meta charset=x><title>t</title><body><article><p>Body text here.</p></article>", "Body text here."),
    ("<head><link href=a><script>1</script>\n<article><p>No body tag.</p></article>", "No body tag."),
    ("<article><p>one</p><svg class='i' href=\"a/b\"/><p>two</p></article>", "one\n\ntwo"),
    ("<article><p>one</p><math/><p>two</p><svg><text>no</text></svg><p>three</p></article>", "one\n\ntwo\n\nthree"),
    ("<article><p>one</p><svg/><p>two</p><svg viewBox='0 0'><text>no</text></svg><p>end</p></article>", "one\n\ntwo\n\nend"),
    ("<article><p>one</p><svg width=1/><text>no</text></svg><p>two</p></article>", "one\n\ntwo"),
])
def test_open_heads_and_self_closed_elements(page, wanted):
    assert html_extract.main_text(page) == wanted


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, wanted = PAGES[name]
    assert html_extract.main_text(page) == wanted


PLAIN = "plain words of the text stand here. " * 6
TEXT, NAV = f"<p>{PLAIN}</p>", "<nav><ul><li><a href=1>one</a><li><a href=2>two</a></ul></nav>"
WHOLE = f"Head\n\n{PLAIN.strip()}"


@pytest.mark.parametrize("page, wanted", [
    (f'<div class="layout no-sidebar">{NAV}<article><h1>Head</h1>{TEXT}</article></div>', WHOLE),
    (f'<div id="page" class="has-nav">{NAV}<h1>Head</h1>{TEXT}</div>', WHOLE),
    (f'<form id="aspnetForm">{NAV}<h1>Head</h1>{TEXT}</form>', WHOLE),
    (f'<form id="aspnetForm">{NAV}<article><h1>Head</h1>{TEXT}</article><footer>foot</footer></form>', WHOLE),
    (f'<nav><ul><li><a href=1>one</a></ul><article><h1>Head</h1>{TEXT}</article><footer>foot</footer>', WHOLE),
    (f'<nav><ul><li><a href=1>one</a></ul><h1>Head</h1>{TEXT}', WHOLE),
    (f'<div id="post-side-effects-of-drug"><h1>Head</h1>{TEXT}</div>', WHOLE),
    (f'<article><h1>Head</h1><div class="share-price">Now 12 dollars</div>{TEXT}<div class="share-buttons">Share</div></article>',
     f"Head\n\nNow 12 dollars\n\n{PLAIN.strip()}"),
    ("<h1>A heading</h1><p>One short paragraph of eight words is here.</p>", "A heading\n\nOne short paragraph of eight words is here."),
    (f'<article><h1>Head</h1>{TEXT}<section class="comments"><article><p>I like it</p></article></section></article>', WHOLE),
    (f'<article><h1>Head</h1>{TEXT}</article><div class="related"><article><a href=1>Other</a><p>its teaser</p></article></div>', WHOLE),
    ("<div class='ad'>" * 60 + f"<article><h1>Head</h1>{TEXT}</article>" + "</div>" * 60, WHOLE),
])
def test_names_give_way_where_they_contradict_the_page(page, wanted):
    assert html_extract.main_text(page) == wanted


def test_verdicts_hang_on_the_neighbours():
    """The same block among texts, among links and alone; and over the table, other neighbours change verdicts."""
    tree = html_extract.trained_tree()
    heading = [html_extract.is_main(tree, (3, 0.0, *near, 0)) for near in ((0, 0.0, 40, 0.0), (2, 1.0, 2, 1.0), (0, 0.0, 0, 0.0))]
    linked = [html_extract.is_main(tree, (6, 1.0, *near, 1)) for near in ((40, 0.0, 40, 0.0), (40, 0.0, 3, 1.0))]
    assert heading == [True, False, True] and linked == [True, False]
    x, y = html_extract.labelled_table()
    rng = np.random.default_rng(5)
    moved = x.copy()
    moved[:, 2:6] = moved[rng.permutation(len(x)), 2:6]
    changed = np.array([html_extract.is_main(tree, tuple(row)) for row in moved]) != y
    assert 0.02 < changed.mean() < 0.5 and changed[x[:, 6] == html_extract.FREE].mean() > 0.1


@pytest.mark.parametrize("seed", range(3))
def test_pages_without_article_against_their_making(seed):
    """Pages put together from text and furniture without any names; the tree has only counts and neighbours."""
    rng, right, total = random.Random(seed), 0, 0
    for _ in range(60):
        text = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([20, 40, 90]))) for _ in range(rng.randrange(2, 6))]
        text.insert(0, "a heading here")
        menu = [f"<li><a href={k}>item {k}</a>" for k in range(rng.randrange(3, 8))]
        page = "<ul>" + "".join(menu) + "</ul>" + "".join(f"<p>{t}</p>" for t in text) + "<ul>" + "".join(menu) + "</ul><p>c 2024</p>"
        found = html_extract.main_text(page).split("\n\n")
        total += 1
        right += found == text
    assert right == total


def feistel(x, n, key):
    """The network by plain numbers, with Spark's hash of two 64-bit numbers."""
    a = math.isqrt(max(n, 1) - 1) + 1
    b = -(-max(n, 1) // a)

    def hashed(value, k):
        h = xxhash.xxh64_intdigest((value % 2**64).to_bytes(8, "little"), 42)
        h = xxhash.xxh64_intdigest((k % 2**64).to_bytes(8, "little"), h)
        return h - 2**64 if h >> 63 else h

    def once(x):
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            k = key * 1000 + i + 1
            left = (left + hashed(right, k) % a) % a
            right = (right + hashed(left, -k) % b) % b
        return left * b + right

    y = once(x)
    while y >= n:
        y = once(y)
    return y


def test_places_match_a_plain_feistel_network(spark):
    rows = [(i, f"t{i}", "en", "s", 0) for i in range(137)]
    found = {r.doc_id: (r.shard, r.slot) for r in sharding.shards_of(docs_of(spark, rows), 16, 99).collect()}
    assert found == {i: ((y := feistel(i, 137, 99)) % 16, y // 16) for i in range(137)}


def test_open_elements_take_linear_time():
    for page in ("<nav>" * 100_000, "<div class=ad>x" * 40_000 + "</div>" * 40_000, "<nav>x" * 60_000 + "</p>" * 60_000):
        started = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - started < 5


def test_tree_learns_its_table():
    x, y = html_extract.labelled_table()
    tree = html_extract.trained_tree()
    assert all(html_extract.is_main(tree, tuple(row)) == bool(label) for row, label in zip(x, y, strict=True))


def test_extracted_rows(spark):
    rows = [(i, f"u{i}", page, "x") for i, (page, _) in enumerate(PAGES.values())] + [(0, "u0", PAGES["plain"][0], "x"), (None, None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html_extract.extracted(pages)
    wanted = [(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES.values())] + [(0, "u0", PAGES["plain"][1], len(PAGES["plain"][1])), (None, None, "", 0)]
    assert collected(found) == sorted(wanted, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert html_extract.extracted(pages.filter("false")).count() == 0


def test_extraction_of_given_pages(spark):
    """Without the tree: in these pages the main text is what lies in the article."""
    found = {r.page_id: r.text for r in html_extract.extracted(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    import html
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert found[r.page_id] == "\n\n".join(p for p in parts if p)




def test_shards_hold_equal_counts_without_gaps(spark):
    rows = [(i % 700, f"text {i % 90}", "en", "s", 0) for i in range(1000)] + AWKWARD
    found = sharding.shards_of(docs_of(spark, rows)).collect()
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(set)
    for r in found:
        slots[r.shard].add(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(slots[s] == set(range(counts[s])) for s in counts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1023])
def test_feistel_walk_is_a_permutation(spark, n):
    from pyspark.sql import functions as F

    places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(places) == list(range(n))
    assert n < 100 or places != sorted(places)


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(i, f"text {i}", "en", "s", 0) for i in range(300)]
    first = collected(sharding.shards_of(docs_of(spark, rows)))
    assert collected(sharding.shards_of(docs_of(spark, rows[::-1]).repartition(5))) == first
    assert sharding.shards_of(empty_of(docs_of(spark))).count() == 0


def brute_ipf(cells, goals, rounds=500):
    weight = dict(cells)
    total = sum(cells.values())
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            sums = defaultdict(float)
            for key, w in weight.items():
                sums[key[d]] += w
            whole = sum(goal[v] for v in sums)
            weight = {k: w * goal[k[d]] / whole * total / sums[k[d]] for k, w in weight.items()}
    return weight


def mixing_rows():
    return [
        (i, "w " * (5 + (i * 37) % 240), ("en", "de", "fr")[(i * i) % 3], ("a", "a", "a", "b", "c")[i % 5], 0) for i in range(400)
    ]


def test_mixing_matches_brute_force(spark):
    rows = mixing_rows()
    found = mixing.mixed(docs_of(spark, rows)).collect()
    cells, dims = Counter(), [Counter(), Counter(), Counter()]
    for r in found:
        cells[r.source, r.lang, r.topic] += r.tokens
        for d, v in enumerate((r.source, r.lang, r.topic)):
            dims[d][v] += r.tokens
    assert sum(cells.values()) == sum(len(r[1].split()) for r in rows)
    goals = [{v: n**mixing.TEMPERATURE for v, n in c.items()} for c in dims]
    weight = brute_ipf(cells, goals)
    scale = mixing.BUDGET_SHARE
    for _ in range(100):
        whole = sum(n for k, n in cells.items() if weight[k] * scale >= n)
        left = sum(w for k, w in weight.items() if w * scale < cells[k])
        scale = max(scale, (mixing.BUDGET_SHARE * sum(cells.values()) - whole) / left)
    for r in found:
        key = (r.source, r.lang, r.topic)
        assert r.weight == pytest.approx(weight[key] / cells[key], rel=1e-4)
        assert r.probability == pytest.approx(min(1, weight[key] / cells[key] * scale), rel=1e-4)
    expected = sum(r.tokens * r.probability for r in found)
    assert expected == pytest.approx(mixing.BUDGET_SHARE * sum(cells.values()), rel=1e-3)
    assert sum(r.tokens for r in found if r.sampled) == pytest.approx(expected, rel=0.1)
    again = {r.doc_id: r.sampled for r in mixing.mixed(docs_of(spark, rows).repartition(7)).collect()}
    assert again == {r.doc_id: r.sampled for r in found}


def test_mixed_copies_have_the_target_shares(spark):
    import corpus_pipeline

    rows = [
        (i, "w " * (20 if i % 10 == 0 else 120 + i % 7), "en" if i % 7 else "de", "a" if i % 3 else f"s{i % 4}", 0)
        for i in range(4000)
    ]
    docs = docs_of(spark, rows, clashes=False)
    copies = Counter({r.doc_id: r.copies for r in mixing.mixed(docs).collect()})
    assert Counter(r.doc_id for r in corpus_pipeline.target_mix(spark, docs, "").collect()) == +copies
    assert max(copies.values()) > 1
    for value in (lambda r: r[3], lambda r: r[2], lambda r: "note" if r[1].count("w") < 100 else "article"):
        now, taken = Counter(), Counter()
        for r in rows:
            now[value(r)] += r[1].count("w")
            taken[value(r)] += r[1].count("w") * copies[r[0]]
        goals = {v: n**mixing.TEMPERATURE for v, n in now.items()}
        for v, goal in goals.items():
            assert taken[v] / sum(taken.values()) == pytest.approx(goal / sum(goals.values()), abs=0.01)


def test_mixing_to_given_targets(spark):
    target = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("absent", 5.0)], "source string, target double")
    found = mixing.mixed(docs_of(spark, mixing_rows()), {"source": target}, temperature=1.0).collect()
    assert all(r.probability == 0 and not r.sampled for r in found if r.source == "c")
    sums = Counter()
    for r in found:
        sums[r.source] += r.tokens * r.weight
    assert sums["a"] == pytest.approx(sums["b"], rel=1e-4) and sums["c"] == 0


def test_mixing_takes_awkward_rows(spark):
    assert mixing.mixed(docs_of(spark)).count() == len(AWKWARD)
    assert mixing.mixed(empty_of(docs_of(spark))).count() == 0
    nothing = docs_of(spark, [(1, None, None, None, None), (2, "", "en", "a", 0)])
    assert mixing.mixed(nothing).count() == 2
    kept = mixing.sample_mix(docs_of(spark))
    wanted = mixing.mixed(docs_of(spark)).filter("sampled")
    assert collected(kept, "doc_id") == collected(wanted, "doc_id") and kept.columns == docs_of(spark).columns
    assert mixing.sample_mix(empty_of(docs_of(spark))).count() == 0
    assert len(LONG) > 100_000
