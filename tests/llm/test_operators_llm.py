"""Every operator against brute force on the small tables and on edge cases: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import html, kernels, langid, license, minhash, mixing, passages, pu, quality, queries, sharding, tiling
from granary.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, shard string, id string, component string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards box daily with five quirky jugglers under a violet moon beneath twelve silver clouds that drift across some calm northern harbour toward one distant unnamed shore"


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r["doc_id"], r["text"] or "", r["lang"], r["source"]) for r in documents.collect()]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    texts = [None, "", "   \n\t ", "one", PROSE, PROSE, PROSE.upper(), "x" * 70_000, "ab " * 30_000, "日本語のテキスト です", PROSE + " again"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "k", "9", "7", "z", "c") for i, t in enumerate(texts)]
    rows += [rows[4], (None, PROSE, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(edges):
    return edges.where("false")


def by(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# op1


def test_mix_against_brute_force(spark, data, texts):
    rows = [r.asDict() for r in queries.op1_curriculum_mix(spark, data).collect()]
    size = {d: len(WORD.findall(t)) for d, t, *_ in texts}
    total = Counter()
    for d, _, _, s in texts:
        total[s] += size[d]
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: dict = {}
    while True:
        rest, share = sum(total.values()) - sum(full.values()), sum(w for s, w in weight.items() if s not in full)
        over = [s for s in names if s not in full and rest * weight[s] / share > 3 * total[s]]
        if not over:
            break
        full |= {s: 3 * total[s] for s in over}
    target = {s: full.get(s, rest * weight[s] / share if share else 0) for s in names}
    taken, largest = Counter(), Counter()
    for r in rows:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[r["source"]])
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(rows) == len(texts)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    again = queries.op1_curriculum_mix(spark, data).repartition(3)
    assert sorted(map(repr, rows)) == sorted(repr(r.asDict()) for r in again.collect())


def test_schedule_inverse(spark):
    times, densities, shares = mixing._schedule(((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
    grid = np.linspace(0, 1, 21)
    fine = np.linspace(0, 1, 200_001)
    mass = np.interp(fine, times, densities)
    cumulative = np.concatenate(([0], np.cumsum((mass[1:] + mass[:-1]) / 2 * np.diff(fine))))
    rows = spark.createDataFrame([(float(q), times, densities, shares) for q in grid], "q double, times array<double>, densities array<double>, shares array<double>")
    got = [r["t"] for r in rows.select("q", mixing.position(F.col("q")).alias("t")).orderBy("q").collect()]
    assert got == pytest.approx(np.interp(grid, cumulative, fine).tolist(), abs=1e-4)


def test_mix_edges(edges, nothing):
    assert mixing.assigned(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    rows = mixing.assigned(edges).collect()
    assert len(rows) == edges.count()
    assert all(r["size"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    out = mixing.mixed(edges)
    assert out.columns == edges.columns
    assert out.count() == sum(r["copies"] for r in rows)


# op2


def base_counts(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_rules_against_brute_force(spark, data, texts):
    got = by(queries.op2_fertility(spark, data))
    for d, t, *_ in texts:
        r, want = got[d], base_counts(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_fertility_of_one_text():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=quality.PIECES)
    with open(quality.PIECES, "rb") as a, open(quality.BYTE_PAIRS, "rb") as b:
        tokenizers = quality._tokenizers(a.read(), b.read())
    import pyarrow as pa

    from granary.llm import kernels

    data, offsets = kernels.buffers(pa.array([PROSE, "zażółć ☃☃ 日本"]))
    out = {k: v.to_pylist() for k, v in quality._measured(data, offsets, tokenizers).items()}
    for i, text in enumerate((PROSE, "zażółć ☃☃ 日本")):
        ids = [x for w in text.split() for x in model.encode(w)]
        counts = np.array(list(Counter(ids).values())) / len(ids)
        assert out["n_tokens"][i] == len(ids)
        assert out["n_byte_tokens"][i] == sum(model.is_byte(x) for x in ids)
        assert out["entropy"][i] == pytest.approx(-(counts * np.log2(counts)).sum())
        assert out["chars_per_token"][i] == pytest.approx(len("".join(text.split())) / len(ids))


def test_long_words_are_tokenised_whole():
    import sentencepiece
    import tiktoken

    with open(quality.PIECES, "rb") as a, open(quality.BYTE_PAIRS, "rb") as b:
        tokenizers = quality._tokenizers(a.read(), b.read())
    word = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 5000))
    out = quality._measured(*kernels.buffers(pa.array([word])), tokenizers)
    assert isinstance(tokenizers[0], sentencepiece.SentencePieceProcessor) and isinstance(tokenizers[1], tiktoken.Encoding)
    assert out["n_tokens"].to_pylist() == [len(tokenizers[0].encode(word))]
    assert out["chars_per_byte_pair"].to_pylist() == [pytest.approx(5000 / len(tokenizers[1].encode_ordinary(" " + word)))]


def test_rules_edges(edges, nothing):
    assert quality.filtered(nothing).count() == 0
    rows = quality.judged(quality.measured(edges)).collect()
    assert len(rows) == edges.count()
    out = quality.filtered(edges)
    assert out.columns == edges.columns
    kept = [r["text"] for r in out.collect()]
    assert set(kept) >= {PROSE, PROSE + " again"} and None not in kept and "one" not in kept
    assert len(kept) == sum(r["kept"] for r in rows)


# op3


PAGES = [
    ("<html><body><nav><a href=/>menu</a></nav><article><h1>T</h1><p>one  two<p>three &amp; four<br>five<div class=comments><p>bad</div><article class='comment'>bad</article></article><footer>f</footer></body>", "T\none two\nthree & four five"),
    ("<body><div class='layout-with-sidebar'><div id=content><h1>Title</h1><p>a b c d e f g h i j k l</p><p>x</p><ul><li>l1<li>l2</ul></div><div class='sidebar'>s s s</div></div><div id='cookie-notice'>c</div><form>f</form>", "Title\na b c d e f g h i j k l\nx\nl1\nl2"),
    ("<header>site</header><main><p>body text here</p><script>var a='</p>';</script><style>p{}</style></main><aside>side</aside>", "body text here"),
    ("<div hidden>no</div><p>yes &#233;&eacute;&nbsp;z</p><div style='display:none'>no</div>", "yes éé z"),
    ("<p>a<![foo[ bar]]> b</p>", "a b"),
    ("plain &lt;x&gt;", "plain <x>"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<script>x</script>", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_main_text_keeps_every_cluster():
    draw = lambda name, n: [f"{name} {i} " + "some words of a long paragraph " * 4 for i in range(n)]
    mark = lambda parts: "".join(f"<p>{p}</p>" for p in parts)
    want = lambda *parts: "\n".join(p.strip() for p in sum(parts, []))
    one, two = draw("first", 20), draw("second", 8)
    page = f"<body><nav>menu</nav><div id=content><div>{mark(one)}</div><div>{mark(two)}</div></div><footer>f</footer></body>"
    assert html.main_text(page) == want(one, two)
    for outer in ("main", "div"):
        page = f"<body><p>x</p><{outer}><section>{mark(two)}</section><article><h1>T</h1>{mark(one)}</article></{outer}><p>y</p></body>"
        assert html.main_text(page) == want(two, ["T"], one)


def test_clusters_decide_without_telling_names():
    long = "some words of a paragraph that is long enough to stand out " * 3
    links = "".join(f"<div><a href=/{i}>link {i}</a></div>" for i in range(12))
    page = f"<body><div>{links}</div><h2>T</h2><p>{long}</p><p>short one</p><p>{long}</p><div>{links}</div><p>{long}</p><div>{links}</div></body>"
    want = "\n".join(["T", long.strip(), "short one", long.strip(), long.strip()])
    assert html.main_text(page) == want
    # without the threshold, or smoothed away, every line is content
    assert "link 3" in html.main_text(page, threshold=0.0) and "link 3" in html.main_text(page, sigma=30.0)


def test_clusters_decide_on_the_tables(spark, data):
    """With tags and names of no meaning the clusters find the articles; without threshold or with smoothed-out ratios they do not."""
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    right = [html.main_text(page) for page in pages]
    assert np.mean([html.main_text(page, threshold=t) != text for page, text in zip(pages, right) for t in (0.0, 3.0)]) > 0.9
    plain = [re.sub(r"<(/?)(article|main|nav|aside|header|footer|form)\b", r"<\1div", re.sub(r'\s(class|id)="[^"]*"', "", page)) for page in pages]

    def scores(**parameters):
        out = []
        for page, text in zip(plain, right):
            got, want = Counter(html.main_text(page, **parameters).split("\n")), Counter(text.split("\n"))
            out.append(2 * (got & want).total() / (got.total() + want.total()))
        return np.array(out)

    usual = scores()
    # an article of some ten characters beside a footer of a hundred cannot be told by clusters
    assert usual.mean() >= 0.9 and usual[[len(text) >= 300 for text in right]].mean() >= 0.98
    for worse in (scores(threshold=0.0), scores(sigma=8.0)):
        assert worse.mean() < 0.8 and (worse < usual).mean() > 0.5


@pytest.mark.parametrize("markup", ["<a", "</a", "<!--", "<!-- a --", "<![if", "<?x", '<a b="', "&#", "<div><a>", "<h2>x</h2><div>"])
def test_malformed_pages_are_linear(markup):
    import time

    began = time.perf_counter()
    assert html.main_text("<p>hello there</p>" + markup * (200_000 // len(markup))).startswith("hello there")
    assert time.perf_counter() - began < 4


def test_markup_without_an_end():
    assert html.main_text("<p>one</p><!-- abc <p>more") == "one"
    assert html.main_text('<p>one</p><script>"<!--"</script><p>two') == "one\ntwo"
    assert html.main_text("<p>one</p><p>two <a href='x") == "one\ntwo"


def test_names_of_an_article_mean_no_layout():
    inner = '<h2 id="navigation">N</h2><section class="side-effects"><p>one</p></section><p class="share-price">two</p><div class="comment-list"><p>bad</p></div><div class="ad">bad</div>'
    assert html.main_text(f"<body><article><p>zero</p>{inner}</article><div class='cookie-notice'>bad</div></body>") == "zero\nN\none\ntwo"


def test_deep_nesting_is_linear():
    import time

    n = 100_000
    for page in ("<span>" * n + "x" + "</span>" * n, "<p><div>" + "<span>" * n + "<p>x</p>" * n, "<b><i>" * n + "</b>" * n + "x"):
        began = time.perf_counter()
        assert html.main_text(page).startswith("x")
        assert time.perf_counter() - began < 20


def test_pages_whole_article(spark, data):
    import html as entities

    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = by(queries.op3_main_text(spark, data), "page_id")
    assert len(got) == len(rows)
    for r in rows:
        body = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = [re.sub("</?b>", "", p).replace("<br>", " ") for p in re.split("</?(?:p|h1)>", body)]
        want = "\n".join(filter(None, (re.sub(r"\s+", " ", entities.unescape(p)).strip() for p in parts)))
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


def test_pages_edges(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>" * 3000 + "deep", 2), (1, "u", "<p>" * 3000 + "deep", 2)], "page_id long, url string, html string, text int")
    rows = html.extract(pages).collect()
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0), ("deep", 4), ("deep", 4)]
    assert html.extract(pages.where("false")).count() == 0


# op4


def shingles(text, k):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def classes(sets, percent):
    """Smallest id reachable over links, by all pairs."""
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_all_pairs(documents, texts, k):
    got = by(minhash.near_duplicates(documents, k=k))
    sets = {d: shingles(t, k) for d, t, *_ in texts}
    want = classes(sets, 80)
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(sets[d]), c, c == d) for d, c in want.items()}


def test_chain_of_near_copies(spark):
    """Copies of copies: hubs do not see all links, and many lie about the threshold."""
    random = np.random.default_rng(7)
    words = [f"w{i}" for i in range(4000)]
    made = [list(random.choice(words, 60))]
    for _ in range(159):
        copy = list(made[int(random.integers(len(made)))])
        for _ in range(int(random.integers(1, 6))):
            copy[int(random.integers(60))] = str(random.choice(words))
        made.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = classes({i: shingles(t, 2) for i, t in rows}, 80)
    assert {d: r["component_id"] for d, r in by(minhash.near_duplicates(docs, k=2)).items()} == want
    # one hub only: the rest goes through the exact join
    assert {d: r["component_id"] for d, r in by(minhash.near_duplicates(docs, k=2, rounds=1)).items()} == want


def test_circulant_signature_estimates_similarity():
    random = np.random.default_rng(3)
    a = random.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:800], random.integers(0, 2**63, 200, dtype=np.uint64)))
    same = np.mean(minhash.signature(a, 400, 1) == minhash.signature(b, 400, 1))
    assert same == pytest.approx(800 / 1200, abs=0.1)


def test_near_duplicates_edges(edges, nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    rows = minhash.near_duplicates(edges, k=2).collect()
    assert len(rows) == edges.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [got[i]["component_id"] for i in (0, 1, 2, 4, 5, 6, 10)] == [0, 1, 2, 4, 4, 4, 4]
    assert all(r["kept"] for r in rows if r["doc_id"] is None)
    out = minhash.deduplicated(edges, k=2)
    assert out.columns == edges.columns
    # rows that repeat document 4 or have no id go by their own texts; the row without a text stays
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([0, 1, 2, 3, 4, 7, 8, 9, None], key=str)


def test_deduplicated_goes_by_texts(spark):
    draw = random_words(np.random.default_rng(14))
    a, b, c = (" ".join(draw(60)) for _ in range(3))
    rows = [(None, a), (None, a), (None, a + " more"), (5, b), (5, c), (5, b), (9, c + " more"), (3, b), (None, None), (None, ""), (7, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string").repartition(3)
    docs = docs.selectExpr("*", *[f"'x' AS `{c}`" for c in ("__dropped", "__file", "__row", "__key", "id", "n")])
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    texts = [t for _, t in got]
    assert sum(t is not None and t.startswith(a) for t in texts) == 1 and sum(t == b for t in texts) == 1 and sum(t is not None and t.startswith(c) for t in texts) == 1
    assert (3, b) in got and len(got) == 6
    # with ids of their own nothing is looked up by place
    own = docs.where("doc_id IN (3, 7, 9)")
    assert minhash.deduplicated(own).count() == own.count()


def test_near_duplicates_of_a_repeated_id(spark):
    draw = random_words(np.random.default_rng(4))
    a, b = draw(60), draw(60)
    copy = lambda words, i: " ".join([*words, f"more{i}"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, copy(b, 1)), (7, copy(a, 2)), (3, " ".join(b)), (11, "c d e f"), (11, "g h i j"), (12, "g h i j"), (13, "k l m"), (13, "k l m")]
    got = by(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=2))
    assert {d: r["component_id"] for d, r in got.items()} == {3: 3, 5: 3, 7: 3, 9: 3, 11: 11, 12: 11, 13: 13}


def test_components_of_a_path(spark):
    n = 40
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(None, 3), (100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


# op5


def test_classifier_holds_out_a_fold(spark, data):
    rows = queries.op5_positive_unlabelled(spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.85


def test_class_prior_and_risk():
    random = np.random.default_rng(0)
    positive = random.normal(2, 1, (2000, 3))
    unlabelled = np.concatenate((random.normal(2, 1, (1200, 3)), random.normal(-2, 1, (800, 3))))
    plain = pu._train(positive, unlabelled, None)
    prior = pu.class_prior(positive @ plain[:-1], unlabelled @ plain[:-1])
    assert prior == pytest.approx(0.6, abs=0.05)
    w = pu._train(positive, unlabelled, prior)
    z = unlabelled @ w[:-1] + w[-1]
    assert ((z[:1200] > 0).mean() > 0.97) and ((z[1200:] < 0).mean() > 0.97)


def test_classifier_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(None, None), (4, 1), (4, 0), (9, None)], "doc_id long, quality int")
    assert pu.classify(edges, labels).count() == edges.count()
    assert pu.classify(nothing, labels).count() == 0
    assert {r["score"] for r in pu.classify(edges, labels.where("false")).collect()} == {0.0}


# op6


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_scan(text):
    w = LICENSE_WORD.findall(text.translate(LOWER))
    found = [(i, label) for phrase, label in license.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


def own_labels(text):
    """Windows of twice a template's words at each of its lengths; a template gives way to a closer one that holds it."""
    words = LICENSE_WORD.findall(text.translate(LOWER))
    told = {label: LICENSE_WORD.findall(t.translate(LOWER)) for label, t in license.TEMPLATES}
    found = []
    for label, t in told.items():
        for first in range(0, len(words), len(t)):
            share = len(set(words[first : first + 2 * len(t)]) & set(t)) / len(set(t))
            if share >= 0.8:
                found.append((label, first, first + 2 * len(t), share))
    holds = lambda a, b: a != b and len(set(told[a]) & set(told[b])) / len(set(told[a])) >= 0.8
    return {a for a, f, b, s in found if not any(s2 > s and f2 < b and f < b2 and holds(a, a2) for a2, f2, b2, s2 in found)}


def test_license_against_brute_force(spark, data, texts):
    got = by(queries.op6_license_join(spark, data))
    for d, t, *_ in texts:
        r, want = got[d], base_scan(t)
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want
        assert set(filter(None, r["labels"].split(","))) == set(filter(None, want[4].split(","))) | own_labels(t)


def test_license_lines(spark):
    lines = ["GNU General-Public, license GNU general public license", "mit license mit license", "Cc-BY cc by by", "redistribution and use in source and binary forms, with or without modification, are permitted provided the following conditions are met", "emit license", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(9, "\n".join(lines)), (10, None)], "doc_id long, text string")
    got = by(license.scan(rows))
    for d, t in [*enumerate(lines), (9, "\n".join(lines)), (10, "")]:
        assert tuple(got[d][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == base_scan(t)
    assert got[3]["labels"] == "bsd" and 0.8 <= got[3]["score"] < 1
    everything = {(r["doc_id"], r["label"]) for r in license.contained(rows).collect()}
    assert (3, "bsd") in everything and (9, "bsd") in everything


def test_license_over_line_ends(spark):
    """Wrapped at any width, behind any comment mark, at any place of a long text: every template is found, the other license beside it too."""
    told = dict(license.TEMPLATES)
    rows, want = [], {}
    for i, (label, text) in enumerate(license.TEMPLATES):
        for k, (mark, width, lead) in enumerate([("", 24, 0), ("// ", 40, 7), (" * ", 72, 31), ("# ", 60, 4000)]):
            body = f"{PROSE} " * (lead // 20) + "x " * (lead % 20) + "\n" + "\n".join(mark + line for line in textwrap.wrap(text, width)) + "\n" + PROSE
            rows.append((10 * i + k, body))
            want[10 * i + k] = {label}
    rows.append((-1, told["bsd"] + " " + told["zlib"].replace("damages", "harm")))
    want[-1] = {"bsd", "zlib"}
    rows.append((-2, PROSE * 50))
    want[-2] = set()
    got = by(license.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for d, t in rows:
        labels = set(filter(None, got[d]["labels"].split(",")))
        assert want[d] <= labels and labels == set(filter(None, base_scan(t)[4].split(","))) | own_labels(t), (d, labels)


def test_license_edges(edges, nothing):
    assert license.scan(nothing).count() == 0
    assert license.scan(edges).count() == edges.count()


# op7


def test_tiles_are_greedy_and_do_not_overlap():
    text, item = "a b c d e f x g h i j k l m".split(), "g h i j k l m a b c d e f".split()
    pairs = np.array([(i, j) for i in range(len(text) - 2) for j in range(len(item) - 2) if text[i : i + 3] == item[j : j + 3]])
    assert tiling.tile(pairs, 3) == [(7, 0, 7), (0, 7, 6)]
    same = np.array([(i, j) for i in range(6) for j in range(3)])  # one word again and again
    assert tiling.tile(same, 3) == [(0, 0, 5)] or tiling.tile(same, 3)[0][2] == 5


def test_reordered_passage_is_found(spark):
    words = [f"word{i}" for i in range(40)]
    item = " ".join(words)
    moved = " ".join(["x"] * 10 + words[20:] + ["y"] * 7 + words[:20])
    docs = spark.createDataFrame([(1, item.upper()), (2, moved), (3, " ".join(words[:15])), (4, None), (5, ""), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "too short")], "item_id long, text string")
    rows = tiling.contamination(docs, bench, block_words=1).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["n_covered"]) for r in rows) == [(0, 7, 40), (0, 7, 40), (1, 7, 40), (1, 7, 40), (2, 7, 40), (2, 7, 40)]
    out = tiling.decontaminated(docs, bench)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "4", "5"]
    # each row goes by its own text
    rows = spark.createDataFrame([(None, "x", item, 1), (1, "y", "clean words", 2), (1, "z", item, 3), (None, None, None, 4)], "doc_id long, __leak string, text string, item_id int")
    assert sorted(r["item_id"] for r in tiling.decontaminated(rows.repartition(2), bench, block_words=1).collect()) == [2, 4]
    assert tiling.contamination(docs, bench.where("false")).count() == 0 and tiling.contamination(docs.where("false"), bench).count() == 0


def test_rolled_hashes():
    random = np.random.default_rng(1)
    words = random.integers(0, 3, 400).astype(np.uint64)
    first = np.array([0, 3, 3, 250, 400])
    hashes, limits = tiling.rolled(words, first, 5)
    at = [i for a, b in zip(first[:-1], first[1:], strict=True) for i in range(a, b - 4)]
    assert len(hashes) == len(at) == limits[-1]
    seen = {}
    for i, h in zip(at, hashes.tolist(), strict=True):
        assert seen.setdefault(tuple(words[i : i + 5].tolist()), h) == h
    assert len(set(seen.values())) == len(seen)


def test_contamination_edges(spark, edges):
    draw = random_words(np.random.default_rng(2))
    stock = "which of the following statements is true of the"
    many = [(i, f"{stock} {' '.join(draw(4))}") for i in range(300)]
    bench = spark.createDataFrame([(1000, "One!"), (1001, "ab " * 12), (1002, PROSE), *many], "item_id long, text string")
    docs = edges.select("doc_id", "text").union(spark.createDataFrame([(50, stock), (51, many[7][1] + " " + " ".join(draw(5000)))], "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in tiling.contamination(docs, bench).collect()}
    assert got >= {(3, 1000), (8, 1001), (4, 1002), (5, 1002), (6, 1002), (None, 1002), (51, 7)}
    # the stock phrase is nine of thirteen words of every item
    assert got - {x for x in got if x[1] < 300} == {(3, 1000), (8, 1001), (4, 1002), (5, 1002), (6, 1002), (10, 1002), (None, 1002)}
    assert {x for x in got if x[1] < 300} == {(d, i) for d in (50, 51) for i in range(300)}


def test_contamination_against_brute_force(spark, data, texts):
    split = lambda t: LICENSE_WORD.findall(t.translate(LOWER))
    items = {r["item_id"]: split(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["n_covered"] for r in queries.op7_string_tiling(spark, data).collect()}
    want = {}
    for d, t, *_ in texts:
        words = split(t)
        at = defaultdict(list)
        for i in range(len(words) - 4):
            at[tuple(words[i : i + 5])].append(i)
        for item, target in items.items():
            if sum(tuple(target[j : j + 5]) in at for j in range(len(target) - 4)) * 5 < len(target) / 2:
                continue
            used_text, used_item, covered = set(), set(), 0
            while True:
                best = (0, 0, 0)
                for j in range(len(target) - 4):
                    for i in at.get(tuple(target[j : j + 5]), ()):
                        n = 0
                        while i + n < len(words) and j + n < len(target) and words[i + n] == target[j + n] and i + n not in used_text and j + n not in used_item:
                            n += 1
                        best = max(best, (n, -j, -i))
                if best[0] < 5:
                    break
                used_text |= set(range(-best[2], best[0] - best[2]))
                used_item |= set(range(-best[1], best[0] - best[1]))
                covered += best[0]
            if covered >= len(target) / 2:
                want[d, item] = covered
    assert got == want and got


# op8


def test_shards_are_even_and_keep_groups(spark, data, texts):
    rows = queries.op8_label_propagation(spark, data).collect()
    want = Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t, *_ in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())


def test_group_of_a_third_fills_few_shards(spark):
    rows = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("pair"), F.floor(F.col("id") / 6))).otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.assign(rows).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text_crc32") == zlib.crc32(b"hot")).alias("hot")).collect()
    assert [r["n"] for r in out] == [150] * 8
    assert sum(r["hot"] for r in out) == 400 and sum(r["hot"] > 0 for r in out) <= 6


def test_shards_edges(edges, nothing):
    assert sharding.assign(nothing).count() == 0
    rows = sharding.assign(edges).collect()
    assert len(rows) == edges.count()
    assert all((r["size"], r["text_crc32"]) == (1, 0) for r in rows if r["doc_id"] in (0, 1))


# op9


def random_words(random):
    return lambda n: [f"t{i}" for i in random.integers(0, 10**6, n)]


def folded(text):
    return [w.translate(LOWER) for w in WORD.findall(text)]


def test_cuts_do_not_depend_on_the_batch(texts):
    def found(batch):
        out = defaultdict(list)
        for low, _, _, first, words in passages._words(pa.array(batch)):
            for row, start, size, content in passages._cut(words, first):
                for x in zip(row.tolist(), start.tolist(), size.tolist(), content.tolist(), strict=True):
                    out[low + x[0]].append(x[1:])
        return out

    batch = [t for _, t, *_ in texts]
    together = found(batch)
    assert all(together[i] == found([t])[0] for i, t in enumerate(batch))


def test_cuts_of_a_window():
    random = np.random.default_rng(2)
    values = random.integers(0, 50, 300).astype(np.uint64)
    limits = np.array([0, 4, 4, 120, 121, 300])
    at = set(passages.cuts(values, limits, 7).tolist())
    for low, high in zip(limits[:-1], limits[1:], strict=True):
        want = {low, high - 1} if high > low else set()
        for i in range(low, high - 6):
            window = values[i : i + 7].tolist()
            if window.count(min(window)) == 1:
                want.add(i + window.index(min(window)))
        assert {int(x) for x in want} <= at
        # nothing else, but ties of a window's edge
        for x in at & set(range(low, high)):
            assert x in want or any(values[i : i + 7].min() == values[x] for i in range(max(low, x - 6), min(x, high - 7) + 1))


def test_repeated_passages_are_found(spark):
    random = np.random.default_rng(11)
    draw = random_words(random)
    passage, other = draw(60), draw(51)
    rows = []
    for i in range(30):
        body = draw(int(random.integers(20, 200)))
        at = int(random.integers(len(body)))
        rows.append((i, " ".join(body[:at] + (passage if i % 3 == 0 else other if i % 3 == 1 else []) + body[at:])))
    docs = spark.createDataFrame(rows + [(99, None), (98, ""), (97, "a b c"), (None, rows[0][1])], "doc_id long, text string").repartition(4)
    found = passages.repeated(docs).collect()
    spans = defaultdict(list)
    for r in found:
        spans[r["doc_id"]].append((r["first_word"], r["first_word"] + r["n_words"], r["kept_doc_id"]))
    for d, t in rows:
        if d % 3 == 2 or d < 3:
            assert d not in spans  # clean, or the copy that stays
        else:
            inserted = passage if d % 3 == 0 else other
            w = t.split()
            start = next(i for i in range(len(w)) if w[i : i + len(inserted)] == inserted)
            # where both texts end with the passage, a last paragraph may go to a later copy
            low, high, kept = min(x[0] for x in spans[d]), max(x[1] for x in spans[d]), {x[2] for x in spans[d]}
            assert d % 3 in kept and all(k % 3 == d % 3 for k in kept) and start <= low <= start + 9 and start + len(inserted) - 9 <= high <= start + len(inserted)
    kinds = defaultdict(set)
    for r in found:
        kinds[r["cluster_id"]].add(r["doc_id"] % 3)
    assert sorted(map(len, kinds.values())) == [1] * len(kinds) and len(kinds) == 2 and set.union(*kinds.values()) == {0, 1}


def test_every_long_copy_of_the_tables_is_found(spark, data, texts):
    """Against all pairs: each place of 51 words that an earlier document has is covered but for nine words at its ends."""
    found = queries.op9_passage_banding(spark, data).collect()
    words = {d: folded(t) for d, t, *_ in texts}
    first, covered = {}, defaultdict(set)
    for d in sorted(words):
        for i in range(len(words[d]) - 50):
            first.setdefault(tuple(words[d][i : i + 51]), d)
    for r in found:
        covered[r["doc_id"]] |= set(range(r["first_word"], r["first_word"] + r["n_words"]))
    copies = 0
    for d, w in words.items():
        for i in range(len(w) - 50):
            if first[tuple(w[i : i + 51])] < d and len(set(w[i : i + 51])) > 10:  # texts of few words have no unequal shingles
                copies += 1
                assert set(range(i + 9, i + 42)) <= covered[d]
    inside = {}
    for d, w in words.items():
        seen = {}
        for i in range(len(w) - 50):
            k = tuple(w[i : i + 51])
            if i >= seen.setdefault(k, i) + 51 and len(set(k)) > 10:
                inside.setdefault(d, []).append(i)
    # a later copy in the same document goes too
    assert all(set(range(i + 9, i + 42)) <= covered[d] for d, at in inside.items() for i in at)
    assert copies and found
    for r in found:
        span = words[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]
        kept = words[r["kept_doc_id"]]
        have = {tuple(kept[i : i + 5]) for i in range(len(kept) - 4)}
        own = [tuple(span[i : i + 5]) for i in range(len(span) - 4)]
        assert r["kept_doc_id"] <= r["doc_id"] and len(span) == r["n_words"]
        assert sum(x in have for x in own) >= 0.33 * len(own)


def test_passages_are_the_same_in_any_partitioning(spark, documents):
    want = sorted(map(tuple, passages.repeated(documents).collect()))
    for again in (documents.coalesce(1), documents.repartition(7, F.rand(3))):
        assert sorted(map(tuple, passages.repeated(again).collect())) == want


def test_passage_with_a_paragraph_elsewhere(spark):
    draw = random_words(np.random.default_rng(3))
    passage = draw(55)
    # document 1 has words of the middle only, so the paragraphs there go to it and the rest to document 5
    texts = {1: draw(30) + passage[12:40] + draw(30), 5: draw(40) + passage + draw(20), 6: draw(25) + passage + draw(35)}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    rows = passages.repeated(docs).where("doc_id = 6").collect()
    covered = set().union(*[range(r["first_word"], r["first_word"] + r["n_words"]) for r in rows])
    assert set(range(34, 71)) <= covered <= set(range(25, 80)) and len({r["cluster_id"] for r in rows}) == 1


@pytest.mark.parametrize("changed,least", [(1, 0.97), (2, 0.95)])
def test_unequal_passages(spark, changed, least):
    random = np.random.default_rng(changed)
    draw = random_words(random)
    rows = []
    for i in range(150):
        passage = draw(60)
        copy = [*passage]
        for at in random.choice(60, changed, replace=False):
            copy[at] = f"new{at}"
        rows += [(i, " ".join(draw(40) + passage + draw(30))), (1000 + i, " ".join(draw(25) + copy + draw(35)))]
    found = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all(r["kept_doc_id"] == r["doc_id"] - 1000 and 25 <= r["first_word"] and r["first_word"] + r["n_words"] <= 85 for r in found)
    assert len({r["doc_id"] for r in found}) >= least * 150


def test_lines_with_a_changed_word(spark):
    draw = random_words(np.random.default_rng(5))
    rows = []
    for i in range(30):
        line = draw(50 + i % 11)
        changed = [*line]
        changed[len(line) // 2] = "changed"
        rows.append((i, "\n".join(map(" ".join, (draw(20), line, draw(9))))))
        rows.append((100 + i, "\n".join(map(" ".join, (draw(9), changed, draw(20))))))
    covered = defaultdict(set)
    for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["kept_doc_id"] == r["doc_id"] - 100
        covered[r["doc_id"]] |= set(range(r["first_word"], r["first_word"] + r["n_words"]))
    assert all(covered[100 + i] == set(range(9, 59 + i % 11)) for i in range(30))


def test_short_lines_with_a_changed_end(spark):
    """Lines of 14 to 48 words that differ in their last word are of one class; those that differ in the middle are not."""
    draw = random_words(np.random.default_rng(12))
    pairs = []
    for n in range(14, 49):
        line = draw(n)
        pairs.append((line, [*line[:-1], "end"], [*line[: n // 2], "middle", *line[n // 2 + 1 :]]))
    rows = [(3 * i + j, " ".join(x)) for i, p in enumerate(pairs) for j, x in enumerate(p)]
    source = passages.source(spark.createDataFrame(rows, "doc_id long, text string"))
    units = passages.keep(passages.map_batches(source, lambda batch: passages._units(batch, 23), passages.SCHEMA))
    of = passages.line_classes(source, units, 80).join(units.where("level = 1"), "content").select("doc", "class").collect()
    classes = {r["doc"]: r["class"] for r in of}
    assert all(classes[3 * i] == classes[3 * i + 1] != classes[3 * i + 2] for i in range(len(pairs)))


def test_copies_within_a_document(spark):
    draw = random_words(np.random.default_rng(6))
    passage = draw(60)
    docs = spark.createDataFrame([(1, " ".join(draw(30) + passage + draw(30) + passage)), (2, " ".join(draw(99)))], "doc_id long, text string")
    assert passages.repeated(docs).count() == 0
    (row,) = passages.repeated(docs, within=True).collect()
    assert (row["doc_id"], row["kept_doc_id"]) == (1, 1) and 120 <= row["first_word"] <= 129 and row["first_word"] + row["n_words"] == 180
    # a line again, its last word changed, beside lines that stand once
    line, other = draw(40), draw(40)
    docs = spark.createDataFrame([(1, "\n".join(map(" ".join, (line, other, draw(35), [*line[:-1], "end"])))), (2, " ".join(draw(99)))], "doc_id long, text string")
    (row,) = passages.repeated(docs, within=True).collect()
    assert (row["doc_id"], row["kept_doc_id"], row["first_word"], row["n_words"]) == (1, 1, 115, 40)
    assert passages.repeated(docs).count() == 0


def test_similar_lines_of_the_tables_are_of_one_class(spark, texts):
    """Recall against all pairs of lines; similar lines of a bucket whose first line is like neither count too."""
    found = defaultdict(set)
    for d, t, *_ in texts:
        for line in map(tuple, map(folded, t.split("\n"))):
            if len(line) >= passages.LINE:
                found[line].add(d)
    sets = {line: {line[i : i + 5] for i in range(len(line) - 4)} for line in found}
    at = defaultdict(list)
    for line, have in sets.items():
        for x in have:
            at[x].append(line)
    pairs = {(a, b) for same in at.values() for i, a in enumerate(same) for b in same[:i] if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))}
    want = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    source = passages.source(spark.createDataFrame([(d, t) for d, t, *_ in texts], "doc_id long, text string"))
    units = passages.keep(passages.map_batches(source, lambda batch: passages._units(batch, 23), passages.SCHEMA))
    classes = {r["content"]: r["class"] for r in passages.line_classes(source, units, 80).collect()}
    order = sorted(found)
    hashes = {}
    for low, data, starts, first, words in passages._words(pa.array(map(" ".join, order))):
        for row, _, _, content, *_ in passages._lined(data, starts, words, first):
            hashes.update({order[low + r]: int(c) for r, c in zip(row, content, strict=True)})
    assert want and all(classes[hashes[a]] == classes[hashes[b]] for a, b in want)
    groups = defaultdict(set)
    for line in order:
        groups[classes[hashes[line]]].add(line)
    linked = {frozenset(p) for p in want}
    for group in groups.values():  # no class without links
        assert len(group) == 1 or all(any(frozenset((a, b)) in linked for b in group) for a in group)


def test_passages_edges(spark, edges, nothing):
    assert passages.repeated(nothing).count() == 0
    assert {r["doc_id"] for r in passages.repeated(edges).collect()} >= {5, 6, 10}
    # a document beyond one chunk, one word again and again, rows that repeat an id with other texts
    draw = random_words(np.random.default_rng(8))
    passage = " ".join(draw(60))
    long = " ".join(draw(200_000))
    rows = [(1, f"{long} {passage}"), (2, f"{passage} {long}"), (3, "ab " * 200_000), (4, passage), (4, f"x y z {passage}")]
    found = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_words"] for r in found if r["doc_id"] == 2) == 200_060
    assert 1 in {r["kept_doc_id"] for r in found if r["doc_id"] == 4} and {r["doc_id"] for r in found} == {2, 4}


# op10


def test_language_of_the_held_out_fold(spark, data, texts):
    got = by(queries.op10_naive_bayes(spark, data))
    held = [(got[d]["lang_pred"], lang) for d, _, lang, _ in texts if lang is not None and got[d]["held_out"]]
    assert held and np.mean([a == b for a, b in held]) > 0.95
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, *_ in texts)


def test_naive_bayes_against_brute_force(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aab ba", "x"), ("bcc cb", "y"), ("ab", "x"), ("cc", "y"), ("abc", None)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, priors, matrix = langid.learn(docs, texts_per_language=1_000_000)
    train = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 5]

    def buckets(text):
        import pyarrow as pa

        from granary.llm import kernels

        parts = langid.grams(*kernels.buffers(pa.array([text])))
        next(parts)
        return np.concatenate([b for b, _ in parts])

    for j, name in enumerate(languages):
        counts = np.full(langid.BUCKETS, 0.5)
        for t, lang in train:
            if lang == name:
                np.add.at(counts, buckets(t), 1)
        assert matrix[:, j] == pytest.approx(np.log(counts / counts.sum()), abs=1e-5)
        assert priors[j] == pytest.approx(np.log(sum(lang == name for _, lang in train) / len(train)))
    for r in langid.predict(docs, languages, priors, matrix).collect():
        total = priors + matrix[buckets(dict((i, t) for i, t, _ in rows)[r["doc_id"]])].sum(axis=0, dtype=float)
        assert r["lang_pred"] == languages[int(total.argmax())]
        assert r["score"] == pytest.approx(np.exp(total.max()) / np.exp(total).sum())


def test_language_edges(edges, nothing):
    assert langid.identify(nothing).count() == 0
    rows = langid.identify(edges).collect()
    assert len(rows) == edges.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_measures_take_bounded_memory():
    import tracemalloc

    tokenizers = quality._tokenizers(*(Path(p).read_bytes() for p in (quality.PIECES, quality.BYTE_PAIRS)))
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 100_000, 400)) for _ in range(1450)] + ["", None]
    (low, high, data, offsets), *rest = kernels.chunks(pa.array(texts), quality.CHUNK)
    assert (low, high, rest) == (0, len(texts), [])
    tracemalloc.start()
    measures = quality._measured(data, offsets, tokenizers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28 * len(data), peak / len(data)
    # a text's measures do not depend on the texts beside it, nor on the slices
    for i in (0, 799, 1449, 1450):
        alone = quality._measured(*next(kernels.chunks(pa.array(texts[i : i + 1])))[2:], tokenizers)
        assert {k: v[i].as_py() for k, v in measures.items()} == {k: v[0].as_py() for k, v in alone.items()}


def test_span_hashes_do_not_depend_on_slices(monkeypatch):
    data = np.frombuffer(b"ab" * 500 + b" c dd  eee", np.uint8)
    starts, ends, _ = kernels.spans(data, np.array([0, len(data)]))
    whole = kernels.span_hashes(data, starts, ends)
    monkeypatch.setattr(kernels, "HASH_BYTES", 3)
    assert (kernels.span_hashes(data, starts, ends) == whole).all()
