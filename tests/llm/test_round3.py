"""Token alignment, vector codes and url filters against brute force, with nulls, ties, odd texts, empty tables and clashing names."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from tidebar.llm import alignment, codes, mixing, queries, reputation
from tidebar.llm.queries import tokenizer
from tidebar.llm.shared import joined_by
from tidebar.llm.tokens import byte_letters

TEXTS = [
    None, "", " ", "a", "the same text twice", "the same text twice", "The Same Text, twice.", "x " * 3000, "ab" * 2000, "don't (stop) we'll go!\r\nnow\r\n", "tab\tand\u00a0wide\u3000blank  two   three\n\n\n end ",
    "\u2581under\u2581line", "a \u2581 b", "<s> </s> <unk> <0x41> <|endoftext|> x", "nul\x00 byte", "\U0001f600 \U0001f468\u200d\U0001f469\u200d\U0001f467 e\u0301t\u00e9 \u4e2d\u6587\u5b57 \u0645\u0631\u062d\u0628\u0627", ";\r x;\r\ty \r z", "\n", "\n\nfoo\nbar\n", "if (a[i] == b) { return c; }\r\n\t// done",
    "\u0085next\u2028line", "1234567 12.5e-7 $9,999.00", "http://a.b-c.de/f_g?h=i&j=k#l", "a" * 5000 + " end", "\ufeffbom \ufffd \ufffe",
]


def rows():
    return [(i, t, "x", i % 2, "y") for i, t in enumerate(TEXTS)] + [(None, "null id, the same", "x", 1, "y"), (4, TEXTS[4], "x", 1, "y")]


def brute_alignment(texts):
    """Per text (n_a, n_b, groups, links) by walking both token lists; then counts over all links."""
    a = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    letter = {c: k for k, c in enumerate(byte_letters())}
    per_text = []
    for text in texts:
        if not text:
            per_text.append(([], [], [], []))
            continue
        data = f" {text}".encode()
        ids = [a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)]
        own = [[bytes(letter[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids[1]]]
        if any(b"".join(x) != data for x in own):
            per_text.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in xs]).tolist() for xs in own]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, last = [], [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids[s], ends[s], strict=True) if last < e <= c) for s in (0, 1)))
            last = c
        at = [dict(zip(ends[s], ids[s], strict=True)) for s in (0, 1)]
        links = [(at[0][c], at[1][c]) for c in cuts]
        per_text.append((ids[0], ids[1], groups, links))
    count = Counter(x for *_, links in per_text for x in links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(len(x), len(y), len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "", ";".join(g)) for x, y, g, k in per_text]


PATHS = (tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [1 << 24, 100])
def test_alignment(spark, monkeypatch, block):
    """One block and many: counts are those of all documents."""
    monkeypatch.setattr(alignment, "BLOCK", block)
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, row string, kind int, groups string").repartition(3)
    want = Counter((r[0], *x) for r, x in zip(data, brute_alignment([r[1] for r in data]), strict=True))
    found = alignment.align(docs, *PATHS).collect()
    assert Counter((r["doc_id"], *(r[f] for f in FIELDS), r["groups"]) for r in found) == want
    assert sum(r["n_a"] == 0 for r in found) == 4  # null, empty, and two texts whose U+2581 comes back as a blank
    assert alignment.align(docs.where("false"), *PATHS).count() == 0


def test_alignment_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = dict(zip(docs, brute_alignment(list(docs.values())), strict=True))
    found = queries.op11_alignment(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in found} == {k: v[:-1] for k, v in want.items()}


def test_coalescing_and_overlaps():
    """Random tilings of one stretch: groups break where both end, overlaps are all pairs that share a byte."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        ends = [np.append(np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 30), replace=False)), 60) for _ in range(2)]
        (sa, ea), (sb, eb) = ((np.concatenate(([0], e[:-1])), e) for e in ends)
        ga, gb = alignment.coalesce(sa, ea, sb, eb)
        common = np.intersect1d(ea, eb)
        assert (ga == np.searchsorted(common, ea)).all() and (gb == np.searchsorted(common, eb)).all()
        assert set(zip(*map(np.ndarray.tolist, alignment.overlaps(sa, ea, sb, eb)), strict=True)) == {(i, j) for i in range(len(ea)) for j in range(len(eb)) if sa[i] < eb[j] and sb[j] < ea[i]}


def brute_codes(data, parts=4, entries=256, rounds=4):
    """data (id, label, vector): the contract in Python's whole numbers."""
    kept = [(i, label, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, label, v in data if v and all(x is not None and np.isfinite(x) for x in v)]
    size = len(kept[0][2]) // parts
    cut = {p: [v[p * size : (p + 1) * size] for *_, v in kept] for p in range(parts)}
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][2]))
    books = [[list(cut[p][k]) for k in order[:entries]] for p in range(parts)]

    def assign(p):
        return [min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), k) for k, e in enumerate(books[p])) for v in cut[p]]

    for _ in range(rounds):
        for p in range(parts):
            own = assign(p)
            for k in range(len(books[p])):
                mine = [v for v, (_, i) in zip(cut[p], own, strict=True) if i == k]
                if mine:
                    books[p][k] = [sum(xs) // len(mine) for xs in zip(*mine, strict=True)]
    final = [assign(p) for p in range(parts)]
    errors = [sum(f[k][0] for f in final) for k in range(len(kept))]
    by_label = Counter()
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] += e
    out = Counter((i, "".join(f"{f[k][1]:02x}" for f in final), errors[k], by_label[label]) for k, (i, label, _) in enumerate(kept))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


SCHEMA = "vec_id long, label int, embedding array<double>, p0 string, of string, error int"
ODD = [(900, 1, None), (901, 1, [None] + [1.0] * 7), (902, 1, [float("nan")] * 8), (903, None, [float("inf")] * 8), (904, 1, []), (905, None, [0.0] * 8)]


def coded(spark, data):
    frame = spark.createDataFrame([(*r, "x", "y", 7) for r in data], SCHEMA).repartition(3)
    found, books = codes.compress(frame)
    return Counter((r["vec_id"], "".join(f"{c:02x}" for c in r["codes"]), r["error"], r["label_error"]) for r in found.collect()), codes.digest(books)


@pytest.mark.parametrize("scale", [1.0, 0.004, 3e5])
def test_codes(spark, scale):
    """Clusters, equal rows and null labels; on a coarse grid with many ties; with numbers too large for exact doubles."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((9, 8))
    data = [(i, [0, 1, 2, None][i % 4], ((centres[i % 9] + 0.3 * rng.standard_normal(8)) * scale).tolist()) for i in range(400)]
    data += data[:5] + [(None, 0, data[7][2]), (3, 1, data[9][2])] + ODD
    assert coded(spark, data) == brute_codes(data)


def test_codes_of_few_vectors(spark):
    data = [(5, None, [0.5] * 8), (2, None, [-0.5001] * 8), (9, 1, [1e30] * 8), (11, 1, [0.25] * 7), (12, 1, [0.25] * 12)]
    found, _ = coded(spark, data)
    assert found == Counter({(2, "00000000", 0, 0): 1, (5, "01010101", 0, 0): 1, (9, "02020202", 0, 0): 1})  # 1e30 counts as 2^62; other lengths are left out
    empty, books = codes.compress(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and [len(b) for b in books] == [0] * 4


def test_codes_query_equals_brute_force(spark, tmp_path):
    data = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()][:300]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").write.parquet(path)
    want, sha = brute_codes(data)
    found = queries.op12_codes(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:4] for r in found) == want and {r["codebooks_sha256"] for r in found} == {sha}


def test_tree_prunes_and_finds_all():
    """On clustered entries whole subtrees are left out; nearest entries are those of a scan, ties to the lower index."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (20, 16))
    entries = centres[rng.integers(0, 20, 256)] + rng.integers(-60, 60, (256, 16))
    entries[200:210] = entries[50:60]
    queries_ = np.concatenate((entries, entries[:100] + rng.integers(-40, 40, (100, 16)), rng.integers(-4000, 4000, (200, 16)))).astype(np.int64)
    d = ((queries_[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    (tree,) = codes.trees([entries])
    index, least = codes.nearest(queries_, entries, tree)
    assert (index == d.argmin(axis=1)).all() and least.tolist() == d.min(axis=1).tolist()
    near = codes.Search(queries_[:356].astype(np.float64))
    near.visit(tree, np.arange(356))
    assert near.compared < 0.5 * 356 * 256


URLS = [
    None, "", "no scheme", "http://", "http:///path", "HTTP://User@EXAMPLE.com:80/De/x", "http://example.com/de/x?y#z", "http://a.example.com/de/", "http://example.com/de", "http://bexample.com/de/", "http://x.example.net/en/1", "http://example.net/fr/", "http://example.net", "http://net/", "http://net?x", "https://deep.a.org/fr/a/b",
    "http://a.org?/fr/", "x://y://z/w", "http://1.2.3.4/a", "http://[::1]:80/a", "http://a.co.uk/", "http://b.a.co.uk./", "http://co.uk/", "ftp://host#frag/x", "http://\u00c9T\u00c9.example.net/en/", "http://a\nb.org/fr/\n?x",
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, a) for a, h, p in reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "<p>words</p>", "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[6], None, "h", "r"), (3, URLS[3], "", "h", "r")], "page_id long, url string, html string, host string, rule string").repartition(3)
    found = reputation.filter_urls(pages).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        host, path, rule, action = brute_url(URLS[r["page_id"]] if r["page_id"] is not None else URLS[6])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (action or "allow")
    assert reputation.filter_urls(pages.where("false")).count() == 0
    names = dict(spark.createDataFrame([(h,) for h in ("a.b.co.uk", "x.example.com.", "u@y.org:8", "1.2.3.4", "local", "co.uk")], "h string").select("h", reputation.registered(reputation.F.col("h"))[0]).collect())
    assert names == {"a.b.co.uk": "b.co.uk", "x.example.com.": "example.com", "u@y.org:8": "y.org", "1.2.3.4": "1.2.3.4", "local": "local", "co.uk": "co.uk"}


def test_reputation(spark):
    """Bad hosts are blocked, hosts with few bad pages are not, unless their domain's record is bad; clean ones stay."""
    hosts = {"bad.a.com": (40, 38), "few.a.com": (2, 2), "good.a.com": (300, 4), "other.b.com": (200, 2), **{f"h{i}.spam.info": (30, 29) for i in range(12)}, "new.spam.info": (1, 0), **{f"s{i}.c.com": (50, 1) for i in range(30)}}
    data = [(f"http://{h}/{i}", int(i < bad)) for h, (n, bad) in hosts.items() for i in range(n)] + [("http://unseen.a.com/", None), ("http://unseen.spam.info/", None)]
    pages = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(data)], "page_id long, url string, bad int").withColumn("html", reputation.F.lit(None).cast("string"))
    verdict = {r["host"]: r["verdict"] for r in reputation.filter_urls(pages, bad=reputation.F.col("bad"), rules=[]).collect()}
    blocked = {h for h, v in verdict.items() if v == "block"}
    assert blocked == {"bad.a.com", "new.spam.info", "unseen.spam.info", *(f"h{i}.spam.info" for i in range(12))}


def test_url_query_equals_its_sql(spark, tmp_path):
    """Also where one host has a third of all pages, html is null or junk, and urls name spam."""
    rng = np.random.default_rng(5)
    junk, clean = "<p>" + "a*** b### c%%% " * 9 + "</p>", "<script>***</script><p>plain words &amp;&amp; more of them</p>"
    made = [(i, URLS[i] if i < len(URLS) else f"http://{'hot' if i % 3 == 0 else 'h' + str(i % 37)}.{['a.com', 'b.org', 'c.co.uk'][i % 37 % 3]}/{i}{'/casino' if i % 37 == 5 else ''}", [clean, junk if i % 37 == 8 else clean, None][int(rng.integers(0, 3))]) for i in range(900)]
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = Counter(tuple(r) for r in queries.op13_url_filter(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert found == Counter(con.execute(reputation.ORACLE).fetchall())
    assert {"allow", "block"} == {r[4] for r in found if r[3] is None}


def test_mix_counts_vary_as_multinomial_draws(spark, monkeypatch):
    """Over 400 shards, counts of each source have the mean and variance of independent draws, and pairs of sources their covariance."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 256)
    wanted = (10_000, 30_720, 61_680)
    n, shards = sum(wanted), sum(wanted) // 256
    sources = spark.createDataFrame([(k, w, 32 * w, 32.0 * w) for k, w in enumerate(wanted, 1)], "s int, blocks long, source_size long, target double")
    share = np.array(wanted) / n
    spread = []
    for seed in (1, 2, 3):
        counts = np.zeros((shards, 3))
        for r in mixing._drawn(sources, seed).collect():
            counts[r["shard"], r["s"] - 1] = r["n"]
        assert (counts.sum(axis=1) == 256).all() and np.abs(counts.sum(axis=0) - wanted).max() <= 2
        spread.append(np.cov(counts.T))
    want = 256 * (np.diag(share) - np.outer(share, share))
    assert np.abs(np.mean(spread, axis=0) / want - 1).max() < 0.2


def test_joined_by_equals_a_left_join(spark):
    """A hot key, rare ones, keys that the table lacks, and struct keys that hold null."""
    rows_ = spark.range(5000).selectExpr("id", "named_struct('k', case when id % 3 = 0 then null when id % 7 = 0 then 'none' else concat('k', id % 1500) end) as key")
    table = rows_.groupBy("key").count().where("key.k is null or key.k <> 'none'").withColumn("x", reputation.F.xxhash64("key"))
    want = Counter(tuple(r) for r in rows_.join(table, rows_["key"].eqNullSafe(table["key"]), "left").select("id", "count", "x").collect())
    for share in (2, 1000):
        assert Counter(tuple(r) for r in joined_by(rows_, table, "key", "count", 5000, share).select("id", "count", "x").collect()) == want
    assert sum(n for (_, c, _), n in want.items() if c is None) > 100


def test_alignment_sums_documents_as_they_pass():
    """No documents of a block are held: each batch is answered before the next one is read."""
    read = []

    def batches():
        kinds = {"block": pa.int64(), "kind": pa.int32(), "row": pa.int64(), "chunks": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "links": pa.list_(pa.int32()), "link_sizes": pa.list_(pa.int32()), "counts": pa.list_(pa.int64()), "best": pa.list_(pa.int64())}
        head = [{"block": 1, "kind": -1, "counts": [5, 7], "best": [0, 1]}, {"block": 1, "kind": 0, "links": [0, 1, 1], "link_sizes": [1, 0, 2]}, {"block": 1, "kind": 1, "row": 0, "chunks": [0, 2], "times": [3, 1]}]
        more = [[{"block": 1, "kind": 1, "row": r, "chunks": [1, 2], "times": [9, r]}] for r in (1, 2)]
        bare = [{"block": 2, "kind": 0, "links": [], "link_sizes": []}, {"block": 2, "kind": 1, "row": 3, "chunks": [], "times": []}]
        for rows in (head, *more, bare):
            read.append(len(rows))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    out, seen = [], []
    for batch in alignment._summed(batches()):
        out += batch.to_pylist()
        seen.append(len(read))
    assert [tuple(r.values()) for r in out] == [(0, 2, 29), (1, 2, 14), (2, 4, 28), (3, 0, 0)]
    assert seen == [1, 2, 3, 4]
