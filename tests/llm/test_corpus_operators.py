import collections
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import html, langid, licenses, quality, queries, rules, simhash, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    return sorted(rows, key=repr)


def prose(draw, words, n):
    return ". ".join(" ".join(draw.choice(words, size=8)) for _ in range(n // 8)) + "."


@pytest.fixture(scope="module")
def draw():
    return np.random.default_rng(3)


# --- language identification

TONGUES = {"aa": "baka tola mina kesu rato", "bb": "strong winter bringt schnee über", "cc": "l'été où ça était très"}


@pytest.fixture(scope="module")
def spoken(spark):
    draw = np.random.default_rng(1)
    rows = [(i, prose(draw, TONGUES[k].split(), 60), k, "x") for i, k in enumerate(list(TONGUES) * 40)]
    rows += [(None, "strong winter", "bb", "x"), (900, None, "aa", "x"), (901, "12 34 !!", "aa", "x"), (902, "", "cc", "x"), (903, prose(draw, TONGUES["cc"].split(), 60), None, "x"), (903, "été " * 30_000, "cc", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language_gradient_is_that_of_the_loss(monkeypatch):
    net = langid.Network(*[w.astype(np.float64) for w in langid.fresh(4, 3, 1)])
    x, y = np.random.default_rng(0).integers(97, 105, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss, grads = langid.gradient(net, x, y)
    for w, g in zip(net, grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, step = w[i], 1e-2
        w[i] = keep + step
        up = langid.gradient(net, x, y)[0]
        w[i] = keep - step
        down = langid.gradient(net, x, y)[0]
        w[i] = keep
        assert abs((up - down) / (2 * step) - g[i]) < 2e-3


def test_language_is_learnt_and_held_out_accuracy_is_high(spoken):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = langid.fit(spoken, ~held_out, sample=60)
    found = langid.identify(spoken, model, {"held_out": held_out}).collect()
    assert len(found) == spoken.count()
    by_id = {r.doc_id: r for r in found}
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    held = [r for r in found if r.held_out and r.doc_id < 120]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert np.mean([r.lang_pred == list(TONGUES)[r.doc_id % 3] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_windows_label_every_byte_once():
    net = langid.fresh(4, 3, 2)
    for size in (1, langid.WINDOW, langid.WINDOW + 1, 3 * langid.WINDOW - 5):
        assert abs(langid.probabilities(net, [b"x" * size, b""])[0].sum() - 1) < 1e-4


def test_a_row_without_an_id_is_not_held_out(spark, spoken, tmp_path):
    spoken.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op1_language_id(spark, str(tmp_path)).collect()
    assert len(found) == spoken.count() and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(r.lang_pred in {*TONGUES, "und"} and 0 <= r.score <= 1 for r in found)


def test_language_without_teachers(spark, spoken):
    model = langid.fit(spoken.limit(0))
    assert {r.lang_pred for r in langid.identify(spoken, model).collect()} == {"und"}
    assert langid.identify(spoken.limit(0), model).collect() == []


def test_more_languages_than_the_bound_are_an_error(spoken):
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.fit(spoken, sample=5, most_labels=2)
    assert langid.fit(spoken, sample=5, most_labels=3).labels == sorted(TONGUES)


# --- quality classifier


def junk(draw, words, kind):
    some = [str(w) for w in draw.choice(words, size=80)]
    return {
        "symbols": " ".join(w + s for w, s in zip(some, ["***", "###", "$$$", "&&&"] * 20)), "shouting": " ".join(w.upper() + "!!" for w in some),
        "bars": " | ".join(some) + " |", "stutter": " ".join(w for w in some[:5] for _ in range(16)),
    }[kind]


@pytest.fixture(scope="module")
def mixed(spark):
    draw, words = np.random.default_rng(5), "the of and to in river stone carries water slowly over old wooden bridges".split()
    rows = [(i, prose(draw, words, 80), 1) for i in range(160)]
    rows += [(1000 + i, junk(draw, words, k), 0) for i, k in enumerate(["symbols", "shouting", "bars", "stutter"] * 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, good int")


def test_weak_labels_separate_junk_from_prose(mixed):
    found = quality.score_documents(mixed, quality.fit(mixed)).join(mixed.select("doc_id", "good"), "doc_id").collect()
    assert np.mean([r.kept == bool(r.good) for r in found]) > 0.97
    assert all(r.kept for r in found if r.good)


def drawn_votes(draw, n, share, on_good, on_bad):
    """Votes of independent labellers with these accuracies on good and on bad documents, and which are good."""
    good = draw.random(n) < share
    right = np.where(good[:, None], draw.random((n, len(on_good))) < on_good, draw.random((n, len(on_bad))) < on_bad)
    return np.where(right == good[:, None], 1, -1), good


@pytest.mark.parametrize("share, on_good, on_bad", [
    (0.8, (1.0, 1.0, 1.0, 1.0), (0.9, 0.8, 0.7, 0.85)),
    (0.8, (0.9, 0.8, 0.7, 0.85, 0.75), (0.9, 0.8, 0.7, 0.85, 0.75)),
    (0.3, (0.9, 0.8, 0.7, 0.85, 0.75), (0.75, 0.85, 0.9, 0.7, 0.8)),
    (0.95, (0.95, 0.99, 0.9, 0.97, 0.92), (0.8, 0.7, 0.9, 0.85, 0.75)),
])
def test_expectation_maximisation_finds_the_labellers_accuracies(share, on_good, on_bad):
    votes, good = drawn_votes(np.random.default_rng(2), 20_000, share, on_good, on_bad)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.fit_votes(patterns.astype(float), counts.astype(float))
    assert abs(model.prior - share) < 0.05
    assert np.allclose(model.on_good, on_good, atol=0.05) and np.allclose(model.on_bad, on_bad, atol=0.08)
    best = np.mean((model.posterior(patterns.astype(float))[which.ravel()] > 0.5) == good)
    assert best > np.mean((votes.sum(1) > 0) == good) - 0.005  # no worse than the majority of votes


def test_kinds_of_junk_and_a_labeller_that_misjudges_a_source():
    draw, n = np.random.default_rng(3), 30_000
    kind = draw.choice(4, size=n, p=[0.85, 0.06, 0.05, 0.04])
    votes = np.ones((n, 7), int)
    for k, labellers in enumerate([(0, 1), (2, 3), (1, 4, 5)], 1):
        for j in labellers:
            votes[(kind == k) & (draw.random(n) < 0.9), j] = -1
    source = draw.random(n) < 0.3
    votes[source, 6] = -1  # always wrong there
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.fit_votes(patterns.astype(float), counts.astype(float))
    kept = model.posterior(patterns.astype(float))[which.ravel()] > 0.5
    assert abs(model.prior - 0.85) < 0.02 and abs(model.on_good[6] - 0.7) < 0.03
    assert kept[(kind == 0) & source].mean() > 0.99 and kept[kind > 0].mean() < 0.15


def test_votes_of_no_and_few_words_and_the_model_of_no_votes():
    assert quality.votes(None) == quality.votes("") == quality.votes("De. Re.") == [0] * len(quality.LABELLERS)
    empty = np.zeros((0, len(quality.LABELLERS)))
    assert quality.fit_votes(empty, np.zeros(0)).posterior(np.zeros((1, len(quality.LABELLERS)))).tolist() == [1.0]


def test_quality_of_odd_documents(odd_documents):
    model = quality.fit(odd_documents)
    scored = quality.score_documents(odd_documents, model).collect()
    assert len(scored) == odd_documents.count()
    assert all(r.score == 0 and not r.kept for r in scored if r.doc_id in (2, 3, 4))
    kept = quality.keep_documents(odd_documents, model)
    assert kept.columns == odd_documents.columns
    assert ordered(r.doc_id for r in kept.collect()) == ordered(r.doc_id for r in scored if r.kept)
    assert quality.score_documents(odd_documents.limit(0)).collect() == []


# --- near-duplicates


def brute_fingerprint(text, shingle=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, near):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i], rows[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprints_in_pieces_equal_brute_force(draw, monkeypatch):
    monkeypatch.setattr(simhash.word_blocks, "__defaults__", (40,))
    for n in (0, 1, 2, 3, 4, 50, 300):
        text = " ".join(draw.choice(["Alpha", "beta", "é", "x\ty", "\x1cz", "G" * 90], size=n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_components_equal_brute_force(spark, odd_documents, draw):
    words = [f"w{i}" for i in range(40)]
    base = [list(draw.choice(words, size=120)) for _ in range(4)]
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    for i in range(60):
        some = list(base[i % 4])
        for _ in range(i % 5):
            some[draw.integers(len(some))] = str(draw.choice(words))
        rows.append((100 + i, " ".join(some)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(prints, lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    for tile in (2048, 3):
        found = simhash.near_duplicate_components(docs, tile=tile).collect()
        assert ordered((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == ordered((i, f, c) for (i, f), c in zip(prints, want))
    assert simhash.near_duplicate_components(docs.limit(0)).collect() == []


def test_components_where_a_block_is_hot(spark, draw):
    prints = np.unique((0x5A5A5 << 44 | draw.integers(0, 1 << 21, 2500)).astype(np.int64))
    fps = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    edges = simhash.links(fps, tile=200)
    from strandline.llm.common import Scratch
    from strandline.llm.components import connected_components

    roots = {r.node: r.root for r in connected_components(edges, Scratch(spark, "test")).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    seen, want = set(), {}
    for i in range(len(prints)):
        front = [i] if i not in seen else []
        seen.update(front)
        while front:
            j = front.pop()
            want[int(prints[j])] = int(prints[i])
            new = [k for k in np.flatnonzero(near[j]).tolist() if k not in seen]
            seen.update(new)
            front += new
    assert {p: roots.get(p, p) for p in want} == want and len(set(want.values())) < len(want)


def test_the_sign_bit_counts_as_any_other(draw):
    top, others = 1 << 63, [1 << b for b in range(63)]
    flips = [top] + [top | a for a in others] + [top | a | b for a, b in itertools.combinations(others, 2)]
    far = [top | a | b | c for a, b, c in itertools.combinations(others, 3)][::40] + [(1 << 64) - (1 << 53), (1 << 64) - 1]
    for base in (0, int(draw.integers(1 << 63))):
        fps = np.array([simhash.signed(base ^ x) for x in [0, *flips, *far]], np.int64)
        near = simhash.hamming(3)(fps, None)(np.array([0]), np.arange(1, len(fps)))[0]
        assert near.tolist() == [True] * len(flips) + [False] * len(far)


def test_long_chains_are_one_component(spark):
    from strandline.llm.common import Scratch
    from strandline.llm.components import connected_components

    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").unionByName(spark.sql("select 500L as a, 500L as b union all select null, 7L"))
    roots = connected_components(edges, Scratch(spark, "test")).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 200


def test_deduplication_keeps_one_of_each_group(spark, odd_documents, draw):
    words = [f"v{i}" for i in range(300)]
    rows, groups = [], []
    for g in range(12):
        text = [str(w) for w in draw.choice(words, size=200)]
        for c in range(4):
            some = list(text)
            if c:
                some[50 * c - 10] = f"changed{c}"  # one word: similarity 0.95
            rows.append((10 * g + c, " ".join(some)))
        groups.append({10 * g + c for c in range(4)})
    half = rows[0][1].split()
    rows.append((999, " ".join(half[:100] + [str(w) for w in draw.choice(words, size=100)])))
    rows.append((0, rows[0][1]))
    kept = [r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert ordered(kept) == ordered([10 * g for g in range(12)] + [999])
    odd = simhash.deduplicate(odd_documents)
    assert odd.columns == odd_documents.columns
    assert ordered(r.doc_id for r in odd.collect()) == ordered([1, 2, None, 5, 6, 7])
    assert simhash.deduplicate(odd_documents.limit(0)).collect() == []


def test_deduplication_is_exact_at_the_threshold(spark):
    rows, kept = [], []
    for g in range(60):
        text = [f"g{g}w{i}" for i in range(100)]
        for c, changed in enumerate([(), (25, 70), (10, 40, 80)]):  # Jaccard 1, 86 / 106 = 0.811 and 81 / 111 = 0.73
            rows.append((10 * g + c, " ".join(f"new{c}" if i in changed else w for i, w in enumerate(text))))
        kept += [10 * g, 10 * g + 2]
    # One fingerprint, as a few shingles outnumber the rest; the sets have 5 of about 130 in common.
    again = "one two three four five " * 400
    rows += [(1000 + k, again + " ".join(f"only{k}x{i}" for i in range(60))) for k in range(3)]
    assert len({simhash.sketch(t).fp for i, t in rows if i >= 1000}) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (1024, 2):
        found = [r.doc_id for r in simhash.deduplicate(docs, tile=tile).collect()]
        assert ordered(found) == ordered(kept + [1000, 1001, 1002])


# --- licence scans


def test_places_equal_brute_force_and_edits_are_bounded(spark):
    texts = [
        "Released under teh MIT License.", "x Licensed under the Apache Licence, Version 2.0", "MIT-license mit license mit license", "all rights reserved", "alle rights", None, "", "Ümit license  General\nPublic license",
        "This work is licensed under the GNU General Public License, version 3.", "submit licenses", "mit " * 5 + "license " + "y " * 40_000 + "apache license",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        want = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert scanned[i].n_words == len(words)
        assert ordered((p.word, p.label) for p in scanned[i].places) == ordered(want)
        for s in scanned[i].spans:
            notice = next(n for n in licenses.NOTICES if n.label == s.label and s.edits <= n.edits)
            assert notice and words[s.first_word : s.last_word + 1]
    assert [(s.label, s.edits > 0) for s in scanned[0].spans] == [("mit", True)]
    assert [s.label for s in scanned[1].spans] == ["apache"]
    digests = {r.doc_id: r for r in licenses.digest(licenses.scan_licenses(docs)).collect()}
    assert digests[2].labels == "mit" and digests[2].n_base == 3 and digests[2].score == 1.0
    assert (digests[5].n_words, digests[5].first_word, digests[5].labels, digests[5].score) == (0, None, "", 0.0)
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_every_edit_within_the_bound_is_found(draw):
    scanner = licenses.scanner()
    for notice in licenses.NOTICES:
        text = list(notice.words)
        for at in sorted(draw.choice(len(text), size=notice.edits, replace=False), reverse=True):
            if text[at] != " ":
                text[at] = "q"
        found = scanner.fuzzy(f" before {''.join(text)} after ")
        assert any(s.label == notice.label for s in found), notice


def test_less_exact_copies_beside_a_better_one_are_found():
    scanner = licenses.scanner()
    for text, edits in (
        (" all rights reservd all rights reserved ", [1, 0]), (" all rights reserved all rights reservd ", [0, 1]),
        (" all rights reservd all right reserved all rights reserved all rihts reserved x ", [1, 1, 0, 1]),
    ):
        spans = [s for s in scanner.fuzzy(text) if s.label == scanner.fuzzy(" all rights reserved ")[0].label]
        assert [(s.first_word, s.last_word, s.edits) for s in spans] == [(3 * k, 3 * k + 2, e) for k, e in enumerate(edits)]
    both = scanner.fuzzy(" released under teh mit license released under the mit license ")
    assert [(s.first_word, s.edits) for s in both if s.label == "mit"] == [(0, 2), (5, 0)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_spans(words, notice):
    """(first word, edits) by trying every run of words, from left to right."""
    starts = np.r_[0, np.cumsum([len(w) + 1 for w in words])]

    def copies(i):
        for j in range(i, len(words)):
            run = " ".join(words[i : j + 1])
            if len(run) > len(notice.words) + notice.edits:
                return
            if len(run) >= len(notice.words) - notice.edits and (d := distance(run, notice.words)) <= notice.edits:
                yield d, i, j

    found, at = [], 0
    while at < len(words):
        if any(copies(at)):
            reach = starts[at] + len(notice.words) + licenses.slack(notice)
            near = [c for i in range(at, len(words)) if starts[i] < reach for c in copies(i) if starts[c[2] + 1] - 1 <= reach]
            edits, first, last = min(near, default=next(copies(at)))
            found.append((first, edits))
            at = last + 1
        else:
            at += 1
    return found


def test_spans_equal_a_search_over_all_runs_of_words(draw):
    notices = (licenses.Notice("one", "all rights reserved", 1), licenses.Notice("two", "released under the mit license", 3))
    scanner = licenses.Scanner(notices)
    letters = list("aders l")
    for _ in range(120):
        text = ""
        for _ in range(int(draw.integers(1, 5))):
            notice = notices[int(draw.integers(2))]
            some = list(notice.words)
            for _ in range(int(draw.integers(0, notice.edits + 2))):
                at, how = int(draw.integers(len(some))), int(draw.integers(3))
                some[at : at + (how != 0)] = [] if how == 1 else [str(draw.choice(letters))]
            text += "".join(some) + draw.choice([" ", " the ", " rights ", " x y z "])
        words = text.split()
        spans = scanner.fuzzy(f" {' '.join(words)} ")
        for notice in notices:
            assert [(s.first_word, s.edits) for s in spans if s.label == notice.label] == brute_spans(words, notice), (notice.label, words)


def test_a_text_full_of_notices_is_searched_in_proportion():
    scanner, text = licenses.scanner(), " all rights reservd" * 20_000 + " "
    spans = scanner.fuzzy(text)
    assert [s.first_word for s in spans] == list(range(0, 60_000, 3))


# --- main text


def page(article):
    return f"<html><head><title>t</title><style>p</style></head><body><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav><div class=ad>Buy now and save a lot of money today.</div><article>{article}</article><footer>&copy; somebody</footer></body></html>"


def test_blocks_of_malformed_pages():
    cut = html.blocks('<p>a<p>b <b>c<br>d</p>e &amp; &am<ul><li>x<li>y</ul><script>var t="</p>";</script><!-- z --> t < 3 <div class=ad>q')
    assert [b.text for b in cut] == ["a", "b c d", "e & &am", "x", "y", "t < 3", "q"]
    assert cut[-1].path == ("div", ".ad")
    assert html.blocks(None) == html.blocks("") == html.blocks("<script>x") == []


@pytest.mark.parametrize("page, want", [
    ('<article><p>a</p><svg class="i"/><p>b</p><p>c<svg><path d="M0"/><svg></svg>x</svg>d</p></article>', ["a", "b", "cd"]),
    ("<p title=it's>first</p><p title='a > b' x=\"c>d\">second</p>", ["first", "second"]),
    ('<p data-x=5" class=y>one</p><p>two</p>', ["one", "two"]),
    ("<p>a<math>x<mi>y</mi></math>b</p><svg><p>never closed</p><p>and more", ["ab", "never closed", "and more"]),
    ("<div>a<select><option>x</select>b<canvas>no</canvas> c<object><p>q</p></object></div>", ["ab c"]),
    ("<p>a</p><script src=x/><p>b</p><STYLE>p{}</STYLE ><p>c</p><title>t</title ><p>d", ["a", "b", "c", "d"]),
    ("<p>a<!-- <p>no</p> -->b</p><!doctype html><?xml x?><p>c &lt;p&gt; &#233;&nbsp;&eacute;&#x4e2d;</p>", ["ab", "c <p> é é中"]),
    ("<p>unclosed <b>bold<p>next</b> one<table><tr><td>x<td>y<tr><td>z</table>after</div></p>", ["unclosed bold", "next one", "x", "y", "z", "after"]),
    ("<p>a < b and c > d</p><p>5<6</p>", ["a < b and c > d", "5<6"]),
    ("<svg/>" * 3 + "text", ["text"]),
    ("<svg a='>'><p>x</p></svg>y" + "<svg>" * 30_000 + "<script/>" * 30_000 + "z", ["yz"]),
])
def test_blocks_of_odd_markup_are_these(page, want):
    assert [b.text for b in html.blocks(page)] == want


def test_a_name_in_another_attribute_is_none():
    (block,) = html.blocks('<div title="class=ad" data-id=sidebar aria-role="menu" CLASS=story>text</div>')
    assert block.path == ("div", ".story")


def test_a_table_of_long_pages_alone_has_its_text(spark, draw):
    words = "the of and to in river stone carries water slowly over old wooden bridges".split()
    paragraphs = [[prose(draw, words, 400) for _ in range(120)] for _ in range(2)]
    rows = [(i, "u", page("".join(f"<p>{p}</p>" for p in some))) for i, some in enumerate(paragraphs)]
    assert all(len(r[2]) > 200_000 for r in rows)
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: "\n".join(some) for i, some in enumerate(paragraphs)}


def test_all_words_of_an_attribute_are_read():
    text = "This looks like plain prose, and it is long enough to be taken for an article's text."
    (block,) = html.blocks(f'<div class="max-w-md mx-auto mt-4 p-6 bg-white rounded shadow-lg mt-4 comments">{text}</div>')
    assert block.path[-1] == ".comments" and len(set(block.path)) == len(block.path)
    assert html.teacher(block) == 0.0


def test_main_text_is_the_article(spark, draw):
    words = "the of and to in river stone carries water slowly over old wooden bridges".split()
    bodies = ["".join(f"<p>{prose(draw, words, 40)}\n &lt;x&gt;" for _ in range(int(draw.integers(1, 6)))) for _ in range(80)]
    rows = [(i, f"u{i}", page(f"<h1>Old bridges</h1>{b}")) for i, b in enumerate(bodies)]
    rows += [(500, "u", None), (501, "u", ""), (502, None, "<nav>only a menu</nav>"), (0, "u0", rows[0][2]), (503, "u", page("<p>" + "word and more. " * 5 + "</p>" * 2) * 1)]
    rows.append((504, "u", page("".join(f"<p>{prose(draw, words, 24)}</p>" for _ in range(1200)))))
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = html.extract(pages).collect()
    assert len(found) == len(rows)
    right = 0
    written = {i: "\n".join(["Old bridges", *(" ".join(p.replace("&lt;x&gt;", "<x>").split()) for p in b.split("<p>")[1:])]) for i, b in enumerate(bodies)}
    for r in found:
        assert r.n_chars == len(r.text)
        if r.page_id in (500, 501):
            assert r.text == ""
        elif r.page_id < 500:
            right += written[r.page_id] == r.text
    assert right >= 79
    long = next(r for r in found if r.page_id == 504)
    assert long.text.count("\n") >= 1190
    assert html.extract(pages.limit(0)).collect() == []


def test_labels_of_a_long_page_are_those_of_one_run(draw, monkeypatch):
    words = "the of and to in river stone carries water slowly over old wooden bridges".split()
    some = html.blocks("<div>" + "".join(f"<p>{prose(draw, words, 24)}</p>" if k % 3 else f"<div>{draw.choice(words)}</div>" for k in range(1300)) + "</div>")
    net = html.fresh(3)
    net.shift[:, html.UNITS : 2 * html.UNITS] = 6  # a memory that reaches over the page
    want = html.chances(net, [html.hashed(some, {})])[0]
    assert len(some) == 1300
    for stretch in (html.STRETCH, 7, 5000):
        monkeypatch.setattr(html, "STRETCH", stretch)
        assert np.allclose(html.label_blocks(net, some, {}), want, atol=1e-5)


def test_lstm_gradient_is_that_of_the_loss():
    net = html.Labeller(*[w.astype(np.float64) for w in html.fresh(1)])
    pages = [html.blocks(page("<p>One two three.<p>Four.")), html.blocks(page("<p>Five"))]
    ready, y = [html.hashed(p, {}) for p in pages], [np.array([html.teacher(b) for b in p], np.float32) for p in pages]
    _, grads = html.gradient(net, ready, y)
    for w, g in zip(net, grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, step = w[i], 1e-2
        w[i] = keep + step
        up = html.gradient(net, ready, y)[0]
        w[i] = keep - step
        down = html.gradient(net, ready, y)[0]
        w[i] = keep
        assert abs((up - down) / (2 * step) - g[i]) < 1e-3


# --- quality rules


def test_counts_equal_brute_force(draw):
    for _ in range(200):
        text = "".join(draw.choice(["a", "b ", "c\n", "# ", "a b c ", "\t", "é ", "|", "\x1c"], size=int(draw.integers(0, 60))))
        words = WORD.findall(text)
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, duplicates = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                duplicates += line in seen
                seen.add(line)
        found = rules.judge(text)
        assert found[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(inside))
        assert found.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (found.base_failed and found.kept)


def test_lines_go_first_then_documents(draw):
    good = "\n".join(prose(draw, [f"w{i}" for i in range(200)], 40) for _ in range(5))
    assert rules.judge(good).kept and rules.judge(good).cleaned == good
    once = rules.judge(good + "\nHOME | NEWS | SPORT | MORE")
    assert once.kept and once.cleaned == good and once.faults == ["navigation"]
    assert not rules.judge(good[:400] + "\n" + "\n".join(f"A{i} | B{i} | C{i} | D{i} | E{i}" for i in range(60))).kept


def test_rules_on_odd_documents(odd_documents):
    judged = {r.doc_id: r for r in rules.judge_documents(odd_documents).collect()}
    assert (judged[2].n_words, judged[2].base_failed, judged[2].kept) == (0, True, False)
    assert judged[5].n_words > 20_000
    cleaned = rules.clean_documents(odd_documents)
    assert cleaned.columns == odd_documents.columns
    assert rules.judge_documents(odd_documents.limit(0)).collect() == []


# --- top-k


def brute_top(rows, k, every):
    usable = [(n, i, [int(np.floor(64 * float(x))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, q, a in usable:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, i, b in usable if m != n and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_top_k_equals_brute_force(spark, draw):
    rows = [(int(i), [float(x) for x in draw.normal(size=8)]) for i in range(150)]
    rows += [(150, rows[3][1]), (151, rows[3][1]), (20, rows[20][1]), (160, None), (161, [1.0, None] * 4), (162, [float("nan")] + [1.0] * 7), (163, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (180, [1.0, 2.0]), (181, [3.0, 4.0]), (200, [])]
    rows += [(220, [1e15, -1e15, 3.0, 1.0, 0.0, 0.0, 0.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    plain = [r for r in rows if r[0] != 220]
    few = spark.createDataFrame([(*r, 1) for r in plain], "vec_id long, embedding array<double>, rank int")
    for shard, block, probe in ((8192, 2048, 32), (7, 2, 3), (64, 3, 1)):
        found = [tuple(r) for r in topk.exact_top_k(few, k=5, shard_rows=shard, block_rows=block, probe=probe).collect()]
        assert ordered(found) == ordered(brute_top(plain, 5, 20))
    found = [tuple(r) for r in topk.exact_top_k(vectors, k=3, probe=2).where("query_id <> 220").collect()]
    clip = lambda x: max(-(1 << 63) + 1, min((1 << 63) - 1, x))
    assert ordered(found) == ordered((q, r, i, clip(x)) for q, r, i, x in brute_top(rows, 3, 20) if q != 220)
    assert topk.exact_top_k(vectors, k=3).where("query_id = 220").count() == 3


def test_top_k_with_equal_and_zero_vectors_and_large_numbers(spark, draw):
    rows = [(i, [0.5, -0.25]) for i in range(60)] + [(i, [0.0, 0.0]) for i in range(60, 90)] + [(i, [float(x) for x in 1e6 * draw.normal(size=2)]) for i in range(90, 150)]
    for some in (rows, rows[:90], [(i, [-1.0, -1.0]) for i in range(30)] + [(40, [1.0, 1.0])]):
        vectors = spark.createDataFrame(some, "vec_id long, embedding array<float>")
        exact = [(i, [float(np.float32(x)) for x in v]) for i, v in some]
        found = [tuple(r) for r in topk.exact_top_k(vectors, k=25, shard_rows=40, block_rows=2, probe=4).collect()]
        assert ordered(found) == ordered(brute_top(exact, 25, 20))


def test_top_k_of_nothing(spark):
    vectors = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")
    assert topk.exact_top_k(vectors).collect() == []
    assert topk.exact_top_k(vectors.limit(0)).collect() == []


# --- the registered queries


@pytest.fixture(scope="module")
def odd_tables(spark, odd_documents, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    odd_documents.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text")).write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_registered_digests_equal_brute_force(spark, odd_documents, odd_tables):
    """The columns that the queries derive, each from the text itself."""
    import hashlib

    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe
    from tokenizers import Tokenizer

    texts = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    own = ordered((r.doc_id, r.fingerprint) for r in queries.op3_simhash(spark, odd_tables).collect())
    assert own == ordered((i, f"{brute_fingerprint(t):016x}") for i, t in texts)

    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = [(i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in texts for ids in [encoding.encode_ordinary(t)]]
    assert ordered(tuple(r) for r in queries.op4_byte_bpe(spark, odd_tables).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == ordered(want)

    found = {r.doc_id: r for r in queries.op5_license_scan(spark, odd_tables).collect()}
    for i, text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        at = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1

    ids = lambda name, end: [(i, [*Tokenizer.from_file(public_tokenizers.path(name)).encode(t, add_special_tokens=False).ids, end]) for i, t in texts]
    crc = lambda some: zlib.crc32(np.array(some, "<u4").tobytes())
    stored, at = [], 0
    for i, some in sorted(ids("byte_bpe_50k.json", 2), key=lambda d: (d[0] is None, d[0])):
        stored.append((i, at, len(some), crc(some)))
        at += len(some)
    assert ordered(tuple(r) for r in queries.op7_token_store(spark, odd_tables).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == ordered(stored)

    cut = [(i, k, s, len(some[s : s + 4096]), crc(some[s : s + 4096])) for i, some in ids("word_bpe_49k.json", 1) for k, s in enumerate(range(0, len(some), 4096))]
    assert ordered(tuple(r) for r in queries.op9_best_fit_packing(spark, odd_tables).select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == ordered(cut)
    assert ordered(r.doc_id for r in queries.op2_quality(spark, odd_tables).collect()) == ordered(i for i, _ in texts)
    judged = {r.doc_id: r for r in queries.op8_quality_rules(spark, odd_tables).collect()}
    assert all(judged[i][1:7] == tuple(rules.judge(t)[k] for k in (0, 1, 2, 3, 4, 5)) for i, t in texts)
