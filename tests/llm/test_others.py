"""Media, pages, classifiers, shards, mixes and vectors against brute force or held-out rows."""

import hashlib
import itertools
import random
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, html_text, media, mixing, quality, sharding, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_media_by_definition(docs):
    texts = dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))
    for r in [*media.round_trip(docs).collect(), *media.round_trip(docs, files=True).collect()]:
        raw = texts[r.doc_id].encode()
        body = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))
        stream = media.wav(body)
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())


def test_shared_chunks_are_stored_once(spark, monkeypatch):
    # One long text held by many rows, one stretch that others share, and texts of their own; frequent chunks are broadcast.
    monkeypatch.setattr(media, "OFTEN", 20)
    rng = random.Random(8)
    long = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common, part = long(60_000), long(30_000)
    texts = [common] * 40 + [long(9000) + part + long(500) for _ in range(10)] + [long(3000) for _ in range(20)] + ["", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table, chunks = media.stored(docs)
    held = [bytes(d) for r in table.select("digests", "own").collect() for d, c in zip(r.digests, r.own, strict=True) if c is not None]
    shared = [bytes(r.digest) for r in chunks.collect()]
    assert len(set(shared)) == len(shared) and len(set(held)) == len(held) and not set(held) & set(shared)
    assert set(held) | set(shared) == {media.digest(c) for t in texts for c in media.chunked(t)[2]}
    got = {r.doc_id: r.media_sha256 for r in media.round_trip(docs).collect()}
    assert got == {i: hashlib.sha256(media.wav(media.payload(t)[0])).hexdigest() for i, t in enumerate(texts)}


def test_cuts_follow_content():
    rng = random.Random(3)
    body = bytes(rng.choice(b"abcdefgh ") for _ in range(200_000))
    chunks = lambda s: {s[a:b] for a, b in zip([0, *media.cuts(s)], media.cuts(s), strict=False)}
    assert b"".join(body[a:b] for a, b in zip([0, *media.cuts(body)], media.cuts(body), strict=False)) == body
    shared = chunks(body) & chunks(b"some bytes in front" + body)
    assert sum(map(len, shared)) > 0.9 * len(body)
    h, slow = 0, []
    for i, b in enumerate(body[:5000]):
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - media.MASK_BITS) == 0 and i + 1 >= media.LEAST:
            slow.append(i + 1)
            break
    assert not slow or media.cuts(body)[0] == slow[0]


def test_labeller_on_unseen_skeletons():
    net, maker = html_text.trained(), html_text.Skeletons(99)
    right = total = 0
    for _ in range(150):
        page, y = maker.page()
        rows = html_text.blocks(page)
        if rows and len(rows) == len(y):
            x, mask = html_text.padded([net.filled(*html_text.vectors(rows))])
            right += ((net.forward(x, mask)[0][0] > 0) == np.array(y, bool)).sum()
            total += len(y)
    assert right / total > 0.98


STORY = "<h1>The old mill</h1><p>Water ran under the wheel for two hundred years before the valley fell silent.</p><p>Then its owner sold the stones, one after the other, and left for the coast.</p><h2>What is left</h2><p>A wall stands there, and the pond, and every spring the herons come back to it.</p>"
AROUND = [
    ('<div class="disqus"><p>Reader: I do not agree with any of this.</p><p>Another: nor do I.</p></div>', True),
    ('<section class="responses"><p>What a lovely piece this was.</p></section>', True),
    ("<p>(c) 2020 Someone</p>", False),
    ("<p>&copy; Old Mill Press. All rights reserved.</p>", False),
    ("<div><h3>3 comments</h3><p>Anna wrote: lovely story. Reply</p><p>Guest says: not true! Reply Report</p></div>", False),
    ("<div><p>We use cookies to improve your experience. Accept all cookies or manage preferences.</p></div>", False),
    ("<div><p>Sponsored: buy now and save with our limited offer, free shipping today!</p></div>", False),
    ('<div class="qx-17"><p>Subscribe to our newsletter. Enter your email address.</p></div>', False),
    ('<form><p>Search</p><label>Name</label><button>Send</button></form>', False),
    ('<aside><h3>Also here</h3><p>Ten mills of the north</p></aside>', False),
]


@pytest.mark.parametrize("wrapping", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>")])
def test_parts_that_are_no_article(wrapping):
    # Pages written by hand, with parts that have no telling tag or name, and comments within the article's element.
    want = "\n\n".join(b.text for b in html_text.blocks(STORY))
    pages = ["<body><nav><a href='/'>Home</a> <a href='/a'>About</a></nav>" + wrapping[0] + STORY + (part + wrapping[1] if inside else wrapping[1] + part) + "</body>" for part, inside in AROUND]
    texts = html_text.main_texts(html_text.trained(), pages)
    wrong = [(part, text) for (part, _), text in zip(AROUND, texts, strict=True) if text != want]
    assert len(wrong) <= 1, wrong


SAID = "<{0} class='{1}'><{2}>Anna: I grew up next to that mill, thank you for writing about it.</{2}><{2}>Ben: My grandfather worked there.</{2}></{0}>"
BOXES = [SAID.format(tag, name, line) for name in ("post-comments", "comments", "article-comments", "entry-reviews", "user-feedback", "comment-thread", "disqus_thread", "reader_replies") for tag, line in (("div", "p"), ("ul", "li"))] + [
    "<div class='newsletter-box'><p>Get our best stories every week, straight to your inbox.</p></div>", "<div class='post-newsletter'><p>Get our best stories every week.</p><button>Join</button></div>", "<aside class='pull'><p>Ten other mills of the north</p></aside>",
    "<div class='ad-slot'><p>The new car is here, drive it today.</p></div>", "<section id='comments'><h2>2 comments</h2><div class='comment'><p>It was not like that at all.</p></div></section>",
]


@pytest.mark.parametrize("wrapping", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div class="entry">', "</div>")])
def test_comments_that_are_named_after_the_article(wrapping):
    # Comments in everyday words, and boxes, within the article's element and after it.
    want = "\n\n".join(b.text for b in html_text.blocks(STORY))
    pages = ["<body><nav><a href='/'>Home</a> <a href='/a'>About</a></nav>" + wrapping[0] + STORY + (box + wrapping[1] if inside else wrapping[1] + box) + "<footer>Imprint</footer></body>" for box in BOXES for inside in (True, False)]
    texts = html_text.main_texts(html_text.trained(), pages)
    assert sum(t != want for t in texts) <= 2


def test_tags_by_hand():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    assert texts('<p title="a > b">one</p><!-- <p>no</p> --><script>"<p>no"</script><p>two<br/>three') == ["one", "two three"]
    # A quote that never closes ends with its tag, and what opens after the last ">" is text.
    assert texts('<p title="x>one</p><p>two <b') == ["one", "two <b"] and texts("a <!-- b") == ["a"] and texts("1 < 2 <3") == ["1 < 2 <3"]
    assert texts("<title>no<body>yes<style>") == ["yes"] and texts("<svg-x>no</svg>yes") == ["yes"] and texts("<header>yes</header>") == ["yes"]


@pytest.mark.parametrize("unit", ["<b ", '<b "a>" ', "<!x", "<script ", '<a title="', "<", "<!--", "</p ", "<div 'a>'x", "<p>&"])
def test_unclosed_tags_take_linear_time(unit):
    took = []
    for n in (4000, 64000):
        began = time.process_time()
        html_text.blocks(unit * n + "<" * n + "<!--")
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.005)


def test_deep_pages_take_linear_time():
    net, took = html_text.trained(), []
    for n in (2000, 16000):
        began = time.process_time()
        assert html_text.main_texts(net, ["<div>z" * n + "</p>" * n]) != []
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


def test_lstm_gradient():
    net = html_text.Lstm()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 4, html_text.WIDTH)).astype(np.float32)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], bool)
    y = rng.integers(0, 2, (3, 4)).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: (np.logaddexp(0, net.forward(x, mask)[0]) - y * net.forward(x, mask)[0])[mask].mean()
    grads = net.grads(x, mask, y)
    before = x[0, 2, html_text.TAGS]
    x[0, 2, html_text.TAGS] = before + 1e-2
    up = loss()
    x[0, 2, html_text.TAGS] = before - 1e-2
    down = loss()
    x[0, 2, html_text.TAGS] = before
    assert abs((up - down) / 2e-2 - grads["x"][0, 2, 0]) < 2e-3
    for k in ("uf", "wb", "o", "cf"):
        i = np.unravel_index(3, net.p[k].shape)
        before = net.p[k][i]
        net.p[k][i] = before + 1e-2
        up = loss()
        net.p[k][i] = before - 1e-2
        down = loss()
        net.p[k][i] = before
        assert abs((up - down) / 2e-2 - grads[k][i]) < 2e-3


def test_page_texts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extracted(pages).collect():
        inner = html[r.page_id].partition("<article>")[2].partition("</article>")[0]
        assert r.n_chars == len(r.text) and r.text == "\n\n".join(b.text for b in html_text.blocks(f"<article>{inner}</article>"))


def _area(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.85), (quality, "quality", 0.97)])
def test_held_out_rows(spark, module, label, least):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = module.scored(spark.read.parquet(f"{sf}/documents.parquet"), labels).toPandas()
    joined = out.merge(labels.toPandas(), on="doc_id")
    held = joined[joined.held_out]
    assert _area(held[label].to_numpy(), held.score.to_numpy()) > least
    assert out.score.between(0, 1).all()


def test_insults_with_letters_put_in(spark):
    # Neighbours differ: a word that always has the same ones would count as part of a shared passage.
    calm = "weather roads rivers bridges gardens music bread winter summer letters".split()
    insults = ("blockhead", "nitwit", "dimwitted")
    texts = [f"about {calm[i % 10]} {w} {calm[i // 6 % 10]} and {i}" for i in range(60) for w in insults] + [f"a calm sentence number {i} about {calm[i % 10]} and {calm[i // 7 % 10]}" for i in range(200)]
    scorer = toxicity.Scorer(toxicity.train(texts, [1] * 180 + [0] * 200))
    assert (scorer.scores([*insults, "n i t w i t", "nit.wit", "you,nitwit,go", "B L O C K H E A D", "all is calm. you dimwitted one!"]) >= 0.7).all()
    assert (scorer.scores(["a calm day", "", "the weather by the rivers", "headed blocks of wood", "a witness knits"]) < 0.1).all()
    rng = random.Random(5)

    def put_in(word, k):
        for _ in range(k):
            i = rng.randint(1, len(word) - 1)
            word = word[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[i:]
        return f"you are a {word} here"

    assert (scorer.scores([put_in(w, 1) for w in insults for _ in range(100)]) >= 0.7).mean() >= 0.9


def test_fours_by_definition():
    words = ["blockhead", "aab", "abcabcab", "x", "blaue Straße", "漢字漢字漢字"]
    word, key, value = toxicity.fours(words)
    letter = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 35
    for i, w in enumerate(words):
        want = {}
        for p in itertools.combinations(range(len(w)), 4):
            if p[-1] - p[0] < toxicity.FOURS_SPAN:
                k = 0
                for c in p:
                    k = k << 6 | letter(w[c])
                want[k] = want.get(k, 0) + toxicity.FOURS_DECAY ** (p[-1] - p[0] - 3)
        norm = sum(v * v for v in want.values()) ** 0.5
        got = dict(zip(key[word == i].tolist(), value[word == i].tolist(), strict=True))
        assert got == pytest.approx({k: v / norm for k, v in want.items()})


def test_kernel_equals_sums_over_all_fours():
    words = ["blockxhead", "blkhead", "blockheads", "headblock", "calm", "nitwits", "unitwise"]
    kernel = toxicity.Kernel(["blockhead", "nitwit"], ["blockhead", "nitwit"])
    vectors = {}
    word, key, value = toxicity.fours(words + kernel.insults)
    for i, w in enumerate(words + kernel.insults):
        vectors[w] = dict(zip(key[word == i].tolist(), value[word == i].tolist(), strict=True))
    at, rows = kernel.values(words)
    for i, w in enumerate(words):
        row = dict(zip(at.tolist(), rows, strict=True)).get(i, np.zeros(4))
        for j, m in enumerate(kernel.insults):
            cosine = sum(v * vectors[m].get(k, 0) for k, v in vectors[w].items())
            assert row[2 + j] == pytest.approx(np.exp((cosine - 1) / toxicity.FOURS_WIDTH) if cosine >= toxicity.FOURS_FLOOR else 0, abs=1e-5)


def test_insults_in_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = toxicity.scored(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id").merge(docs.select("doc_id", "text").toPandas(), on="doc_id")
    held = out[out.held_out]
    marked = held.text.str.contains(r"\b(?:idiot|moron|scum|trash|clown|loser|worthless|pathetic|disgusting|stupid)\b")  # those of the tables
    assert held[marked & (held.toxic == 1)].predicted.mean() >= 0.95 and held[held.toxic == 0].predicted.mean() <= 0.02


def test_class_prior():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (4000, 4)), rng.normal(3, 1, (1000, 4))
    assert abs(quality.class_prior(good[:2000], np.vstack([good[2000:], bad])) - 2 / 3) < 0.08


def test_min_cost_flow_moves_least():
    rng = random.Random(2)
    for _ in range(200):
        n, m = rng.randint(1, 7), rng.randint(1, 7)
        have = [rng.randint(0, 50) for _ in range(n)]
        room = [0] * m
        for _ in range(sum(have)):
            room[rng.randrange(m) if rng.random() < 0.5 else 0] += 1
        flow = sharding.min_cost_flow(have, room, [i if i < m else None for i in range(n)])
        assert all(sum(f for (i, j), f in flow.items() if i == k) == have[k] for k in range(n)) and min(flow.values(), default=1) > 0
        assert all(sum(f for (i, j), f in flow.items() if j == k) == room[k] for k in range(m))
        assert sum(f for (i, j), f in flow.items() if i == j) == sum(min(have[k], room[k]) for k in range(min(n, m)))


def test_network_against_all_flows():
    # Small networks with costs of their own, against a search through all integer flows.
    rng = random.Random(4)
    for _ in range(60):
        arcs = [(a, b, rng.randint(0, 2), rng.randint(0, 3)) for a in range(4) for b in range(1, 5) if a != b and rng.random() < 0.6]
        best = {0: 0}
        for parts in itertools.product(*(range(r + 1) for _, _, r, _ in arcs[:8])):
            net = [0] * 5
            for (a, b, _, _), f in zip(arcs, parts, strict=False):
                net[a] -= f
                net[b] += f
            if not any(net[1:4]):
                cost = sum(f * x[3] for x, f in zip(arcs, parts, strict=False))
                best[net[4]] = min(best.get(net[4], 99), cost)
        solver = sharding.Network(5)
        made = [solver.arc(*x) for x in arcs[:8]]
        solver.solve(0, 4)
        flow = [solver.room[e + 1] for e in made]
        sent = sum(f for (a, b, _, _), f in zip(arcs, flow, strict=False) if b == 4) - sum(f for (a, b, _, _), f in zip(arcs, flow, strict=False) if a == 4)
        assert sent == max(best) and sum(f * x[3] for x, f in zip(arcs, flow, strict=False)) == best[sent]


def test_shards(docs):
    out = sharding.resharded(docs).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() < 0.05 * sizes.mean()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    want = sorted((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert sorted(zip(out.doc_id, out["size"], out.text_crc32, strict=True)) == want


def test_blocks_follow_the_flow(spark, docs):
    # Within an old shard the rows that aren't dealt alone lie in blocks, each of its flow's bytes but for a document.
    rows = sharding.laid(docs)
    placed, _ = sharding.plan(rows)
    out = sharding.assigned(rows).drop("doc").toPandas()
    total, sizes = out["size"].sum(), out.groupby("old_shard")["size"].sum()
    assert {r.row: r.shard for r in out.itertuples() if r.row in placed} == placed
    small = out[~out.row.isin(placed)]
    taken = out[out.row.isin(placed)].groupby("shard")["size"].sum()
    olds = sorted(sizes.index)
    room = sharding.level_capacities(int(total), [int(taken.get(j, 0)) for j in range(16)])
    left = small.groupby("old_shard")["size"].sum()
    flow = sharding.min_cost_flow([int(left.get(o, 0)) for o in olds], room, [o if o < 16 else None for o in olds])
    for i, o in enumerate(olds):
        part = small[small.old_shard == o].sort_values("position")
        order = part.shard.tolist()
        assert order == sorted(order) and set(order) <= {j for a, j in flow if a == i}
        for j in set(order):
            assert abs(part[part.shard == j]["size"].sum() - flow[i, j]) <= small["size"].max()
    moved = out[out.shard != out.old_shard]["size"].sum()
    share = total // 16
    least = total - sum(min(sizes[o], share) for o in olds if o < 16)
    assert moved <= least + 16 * out["size"].max()


def test_copies_are_parted(spark):
    from pyspark.sql import functions as F

    made = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), F.pmod(F.xxhash64("id"), F.lit(14)).cast("int")).alias("text"), F.lit("s").alias("source"))
    same = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 60).alias("text"), F.lit("s").alias("source"))
    out = sharding.resharded(made.union(same)).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == 34_000 and sizes.max() - sizes.min() <= 2 * 61 and len(sizes) == 16
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in out.groupby("shard"))


def test_rewrite(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    large = spark.range(8).select(F.lit(3).cast("long").alias("doc_id"), F.repeat(F.lit("word "), 9000).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(45_000).cast("long").alias("n_chars"))
    both = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(large).withColumn("shard", F.lit("kept"))
    both.write.parquet(f"{tmp_path}/in")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int")
    changed = sharding.rewrite(spark, f"{tmp_path}/in", f"{tmp_path}/out", old, 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert changed.where("changed").count() == 4 and back.count() == both.count() and set(back.columns) == {*both.columns, "_shard"}
    assert back.select(*both.columns).exceptAll(both).count() == 0 and both.exceptAll(back.select(*both.columns)).count() == 0


def test_rewrite_leaves_shards_alone(spark, tmp_path):
    # Old shards 0 to 5 to four new ones: 0 and 1 are as large as they shall be, 4 and 5 lose everything.
    from pyspark.sql import functions as F

    docs = spark.range(400).select("id", F.col("id").alias("doc_id"), F.lit("t" * 9).alias("text")).drop("id")
    docs.write.parquet(f"{tmp_path}/in")
    old = F.when(F.col("doc_id") < 200, F.col("doc_id") % 2).otherwise(2 + F.col("doc_id") % 4)
    found = {r.shard: r.changed for r in sharding.rewrite(spark, f"{tmp_path}/in", f"{tmp_path}/out", old, 4).collect()}
    assert found == {0: False, 1: False, 2: True, 3: True, 4: True, 5: True}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().collect()} == {(2, 100), (3, 100)}


def test_mix_equals_sql(docs, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(mixing.SQL).df().sort_values("doc_id", ignore_index=True)
    got = mixing.mixed(docs).toPandas().sort_values("doc_id", ignore_index=True)[list(want.columns)]
    pd.testing.assert_frame_equal(got, want)
    assert mixing.repeated(docs).count() == got.times.sum() and (got.taken <= 3 * got["size"]).all()


def test_targets_by_resharing(spark):
    sizes = {"a": 5, "b": 100, "c": 1, "d": 40, None: 7}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in sizes if k not in fixed]
        left = total - sum(fixed.values())
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k]]
        if not over:
            break
        fixed |= {k: 3 * sizes[k] for k in over}
    assert got == pytest.approx(fixed | share)


def test_hilbert_steps_to_neighbours():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    order = cells[np.argsort(ann.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert _recall(table, ann.nearest(table).toPandas()) >= 0.9


def _recall(table, got):
    v = table.toPandas()
    x = np.stack(v.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    queries = np.flatnonzero(v.vec_id % 50 == 0)
    for q in queries:
        near = x @ x[q]
        near[q] = -9
        want = set(v.vec_id.to_numpy()[np.argsort(-near)[:5]])
        hits += len(want & set(got[got.query_id == v.vec_id[q]].vec_id))
    return hits / (5 * len(queries))


def test_windows_of_clusters_are_narrow(spark, monkeypatch):
    # 6,000 vectors in 600 tight clusters: windows are small, blocks smaller than the index, and most is never looked at.
    monkeypatch.setattr(ann, "BLOCK", 256)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(600, 32)), 10, axis=0) + rng.normal(scale=0.05, size=(6000, 32))
    table = spark.createDataFrame(pd.DataFrame({"vec_id": rng.permutation(6000), "embedding": x.tolist()}))
    widths, seen = [], []
    width, windows = ann.window_width, ann.windows
    monkeypatch.setattr(ann, "window_width", lambda *a: widths.append(width(*a)) or widths[-1])
    monkeypatch.setattr(ann, "windows", lambda *a: seen.append(windows(*a)) or seen[-1])
    assert _recall(table, ann.nearest(table).toPandas()) >= 0.95
    assert widths[0] <= 60 and seen[0].groupBy("q").count().agg({"count": "max"}).first()[0] <= 2 * ann.CURVES * ann.TAKEN


def test_windows_hold_their_ranks_only(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "TAKEN", 1000)
    rng = np.random.default_rng(3)
    rows = pd.DataFrame([(lane, i, i * 7 % 300 + lane, rng.integers(-99, 99, 4).astype(np.int8).tobytes()) for lane in (192, 193) for i in range(300)], columns=["lane", "rank", "gid", "code"])
    order = spark.createDataFrame(rows, "lane long, rank long, gid long, code binary")
    wanted = spark.createDataFrame([(14,), (1,)], "gid long")
    got = {(r.q, r.gid) for r in ann.windows(order, wanted, 20).collect()}
    want = {(q.gid, r.gid) for q in rows.itertuples() if q.gid in (14, 1) for r in rows.itertuples() if r.lane == q.lane and abs(r.rank - q.rank) <= 20}
    assert got == want


def test_vectors_of_any_length_and_size(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)] + [(200, rng.normal(size=9).tolist()), (201, [])]
    rows += [(250, [1e200, 1e200, 0.0]), (251, [1e-200, 1e-200, 0.0]), (252, [3e200, 3e200, 1e190])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert sorted(out["query_id"].unique()) == [0, 50, 100, 150, 250] and (out.groupby("query_id").size() == 5).all()
    top = out[out.query_id == 250].sort_values("rank")
    assert top.vec_id.tolist()[:2] == [251, 252] and np.allclose(top.score[:2], 1) and out.score.between(-1.0001, 1.0001).all()


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50, 60)] + [(i, [2.0, 1.0]) for i in (7, 3, 5)] + [(i, [2.0, -1.0]) for i in (4, 6)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert out.sort_values("rank").vec_id.tolist() == [51, 52, 53, 54, 55]
    out = ann.nearest(spark.createDataFrame(rows[9:] + [(100, [1.0, 0.0])], "vec_id long, embedding array<double>")).toPandas()
    assert out.sort_values("rank").vec_id.tolist() == [59, 3, 4, 5, 6]


def test_quality_where_every_document_has_a_label(spark):
    # The other fold's rows serve as unlabelled text, their labels unseen; rows that share an id come to the driver once.
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "ran", "slowly", "past", "old", "stones"]) for _ in range(40)) + "."
    bad = lambda: "$$$ " + "!!! BUY " * rng.randint(5, 20)
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, rows[1][1])] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels).collect()}
    assert np.mean([(got[i] >= 0.3) == (q == 1) for i, _, q in rows]) > 0.95
    # Labels of that fold change nothing.
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.scored(docs, other).collect()} == got
    assert quality.learned(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), labels) is None


def test_mixing_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 1, 2, 3, 4), (2, "d", "t", 1, 2, 3, 4)], "doc_id long, text string, source string, of int, rate int, copy int, _of int")
    for d in (docs, docs.withColumnsRenamed({"of": "__of", "rate": "__rate", "copy": "__copy"})):
        out = mixing.repeated(d)
        assert out.columns == d.columns and out.count() >= 1
