"""Keys of long words, host reputation, the Merkle manifest and periodic runs, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, ODD, check_pieces

from lakewarden.llm import common, hosts, merkle, neardup, packing, periods, queries, sampling, secrets
from lakewarden.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Keys of words


def thue_morse(n):
    """A word over a and b, and its complement: sums modulo 2**64 alone give both one key."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1 << 10, 1 << 12, 1 << 16, 1 << 20, 1 << 21])
def test_keys_tell_words_apart(n):
    one, two = (w.encode() for w in thue_morse(n))
    data = np.frombuffer(b" ".join([one, two, b"x", one]), np.uint8)
    begins, ends = np.array([0, n + 1, 2 * n + 2, 2 * n + 4]), np.array([n, 2 * n + 1, 2 * n + 3, 3 * n + 4])
    for terms in (common.EXACT, common.FOLDED):
        keys = common.keys_of_spans(data, begins, ends, terms)
        assert keys[0] == keys[3] and len(set(keys.tolist())) == 3


def test_products_modulo_the_prime():
    rng = random.Random(3)
    pairs = [(rng.randrange(common.PRIME), rng.randrange(common.PRIME)) for _ in range(500)] + [(common.PRIME - 1, common.PRIME - 1), (0, 5)]
    x, y = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    assert common._product(x, y).tolist() == [a * b % common.PRIME for a, b in pairs]


def test_keys_fold_case_alone():
    data = np.frombuffer(b"Hello hello [ {", np.uint8)
    begins, ends = np.array([0, 6, 12, 14]), np.array([5, 11, 13, 15])
    folded, exact = (common.keys_of_spans(data, begins, ends, t).tolist() for t in (common.FOLDED, common.EXACT))
    assert folded[0] == folded[1] == exact[1] != exact[0] and folded[2] != folded[3]


def test_operators_tell_long_words_apart(spark):
    words = [w for n in (1024, 4096, 65536) for w in thue_morse(n)]
    texts = {i: f"{w} and {w}" for i, w in enumerate(words)}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    check_pieces(packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect(), texts)
    assert all(r.kept for r in neardup.link(docs, size=2).collect())
    assert all(r.lossless for r in sampling.round_trip(docs, tokenizer_path("piece_bpe_32k.model"), seed=1).collect())


def test_all_letters_of_a_word_count():
    """Also those after the 24th, in the field's hash of letters, whatever stands between them."""
    words = ["A" * 30 + "b", "a" * 30 + "c", "aaa-" * 10 + "b", "12", "xyZ" * 50_000, "Ab1c"]
    found = secrets.respects(words)[:, secrets.LETTERS].tolist()
    for word, own in zip(words, found, strict=True):
        h = 0
        for c in (c.lower() for c in word if c.isalpha()):
            h = (h * 31 + ord(c)) % 1_000_003
        assert own == h % (1 << 12)
    assert found[0] != found[1]


# 11 hosts


def plain_judge(urls):
    """page: (host, path, rule, verdict, mean, lower), one url at a time."""
    parsed, out = {}, {}
    for page, url in urls.items():
        rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in hosts.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parsed[page] = (host, path, *(max(fits)[1:] if fits else (None, None)))

    def domain_suffix(host):
        name = re.sub(r":[0-9]*\Z", "", re.sub(r"^.*@", "", host, flags=re.S)).removesuffix(".")
        if re.fullmatch(r"[0-9]+(\.[0-9]+){3}|\[.*\]", name) or "." not in name:
            return name, name
        labels = name.split(".")
        take = 2 if len(labels) > 1 and labels[-2] in hosts.SECOND.split("|") and re.fullmatch("[a-z]{2}", labels[-1]) else 1
        return ".".join(labels[-take - 1 :]), ".".join(labels[-take:])

    known = {h: domain_suffix(h) for h, *_ in parsed.values()}
    counts = defaultdict(lambda: [0, 0])
    for host, _, _, verdict in parsed.values():
        for key in ((3, host), (2, known[host][0]), (1, known[host][1]), (0, "")):
            counts[key][0] += verdict is not None
            counts[key][1] += verdict == "block"
    n, k = counts[0, ""]
    mean, posterior = {(0, ""): (k + 1) / (n + 2)}, {(0, ""): (k + 1, n - k + 1)}
    up = {(1, s): (0, "") for _, s in known.values()} | {(2, d): (1, s) for d, s in known.values()} | {(3, h): (2, d) for h, (d, _) in known.items()}
    for level in (1, 2, 3):
        groups = [(key, *counts[key], mean[up[key]]) for key in up if key[0] == level]
        excess = sum((k - n * m) ** 2 - n * m * (1 - m) for _, n, k, m in groups)
        room = sum(n * (n - 1) * m * (1 - m) for _, n, _, m in groups)
        rho = round(excess / room, 9) if room > 0 else 0
        strength = min(hosts.MOST, max(hosts.LEAST, 1 / rho - 1)) if rho > 1 / (hosts.MOST + 1) else hosts.MOST
        for key, n, k, m in groups:
            own = min(strength, sum(posterior[up[key]]))  # no surer than what the centre rests on
            posterior[key] = own * m + k, own * (1 - m) + n - k
            mean[key] = posterior[key][0] / sum(posterior[key])
    for page, (host, path, rule, verdict) in parsed.items():
        a, b = posterior[3, host]
        lower = a / (a + b) - 1.645 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        out[page] = (host, path, rule, verdict or ("block" if round(lower, 6) >= 0.5 else "allow"), a / (a + b), lower)
    return out


def check_judged(df, urls):
    found, wanted = {r.page_id: r for r in hosts.judge(df).collect()}, plain_judge(urls)
    assert found.keys() == wanted.keys()
    for page, r in found.items():
        assert tuple(r)[1:5] == wanted[page][:4], urls[page]
        assert (r.mean, r.lower) == pytest.approx(wanted[page][4:], abs=2e-6)
    return found


def test_hosts_of_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    check_judged(pages, {r.page_id: r.url for r in pages.select("page_id", "url").collect()})


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http://A.B.Example.ORG/es/x?y", "http://example.org/es", "http://example.org/en/1x#/z", "http://notexample.org/es/", "http://org/", "http://x.org", "http://x.org?/a/",
    "http://u:p@Shop.example.co.uk:8080/de/", "http://a.example.co.uk./", "http://b.com/de/1", "http://b.com/de/2", "http://b.com/de/3", "http://b.com/en/", "http://127.0.0.1/x", "http://[::1]:80/", "http://ÀÉ.com/fr/", "a://b://c/d", "http://localhost", "http://.com/de/", "http://..", "x\n://y.net/\n/z?",
]


def test_odd_urls(spark):
    rng = random.Random(2)
    urls = dict(enumerate(ODD_URLS + [f"http://h{rng.randrange(12)}.d{rng.randrange(3)}.{rng.choice(['com', 'net', 'co.uk'])}/{rng.choice(['de', 'fr', 'en'])}/" for _ in range(400)] + ["http://bad.com/de/"] * 60 + ["http://bad.com/en/"]))
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in urls.items()], "page_id long, url string, host string, mean int")
    found = check_judged(df, urls)
    assert found[max(urls)].verdict == "block" and found[max(urls)].rule is None  # the host is known as a bad one
    long = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "com/de/" + "x" * 100_000), (1, "http://b.com/de/"), (1, "http://b.com/de/"), (None, "http://b.com/")], "page_id long, url string")
    assert Counter(r.verdict for r in hosts.judge(long).collect()) == {"block": 4}  # all that is known speaks against them
    assert hosts.judge(df.limit(0)).collect() == []


def test_outcomes_may_be_unknown(spark):
    none = spark.createDataFrame([("a.com", None), ("b.com", None)], "host string, blocked boolean")
    assert {(r.n, r.mean) for r in hosts.reputations(none).collect()} == {(0, 0.5)}


# 12 manifest


def plain_manifest(rows, arity=8):
    """Rows (doc_id, source, lang, n_chars, text) to the query's rows, tree by tree."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    write = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*(write(v) for v in r))

    def tree(nodes):
        """The root, and of each node its siblings on the left and on the right, level by level."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, place in enumerate(at):
                run = place // arity * arity
                steps[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + arity])))
            nodes, at = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)], [p // arity for p in at]
        return nodes[0], steps

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
        own[lang] = tree([leaf(r) for r in groups[lang]])
    if not langs:
        return []
    root, upper = tree([own[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, upper, strict=True):
        for r, below in zip(groups[lang], own[lang][1], strict=True):
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                now = (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf(now)
            for before, after in below + above:
                node = h(before, node, after)
            out.append((r[0], leaf(r), own[lang][0], root, h(*(x for step in below + above for x in step)), node, node == root))
    return out


def shown(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def test_manifest_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    found = merkle.manifest(docs).collect()
    assert shown(found) == shown(plain_manifest([tuple(r) for r in docs.collect()]))
    assert {r.verified for r in found} == {True, False} and len({r.root for r in found}) == 1


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_manifests_of_any_arity(spark, arity):
    rng = random.Random(arity)
    rows = [(i, "s", lang, 3, rng.choice(["Ab", "ab", None])) for lang, n in ((None, 1), ("a", arity), ("b", arity + 1), ("c", 70), ("ü", 2), ("", 5)) for i in range(1000 * n, 1001 * n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert shown(merkle.manifest(docs, arity).collect()) == shown(plain_manifest(rows, arity))


def test_manifest_cases(spark, odd, none):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in ODD]
    assert shown(merkle.manifest(odd).collect()) == shown(plain_manifest(rows))
    assert merkle.manifest(none).collect() == []
    same = [(7, "s", "en", 1, "x")] * 30  # rows equal in all stand for each other
    clash = spark.createDataFrame([(*r, "c", 1) for r in same], "doc_id long, source string, lang string, n_chars long, text string, tree string, index int").repartition(3)
    assert shown(merkle.manifest(clash).collect()) == shown(plain_manifest(same))


@pytest.mark.parametrize("name", ["op11_host_reputation", "op12_merkle_manifest"])
def test_query_equals_its_sql(spark, data, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    ours = queries.queries()[name](spark, data)
    theirs = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert shown(ours.select(*columns).collect()) == shown(theirs.fetchall())


# 13 runs


def plain_runs(words):
    """(start, length, period), tried for every period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_detect(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (doc_id, len(found), s, length, q, 1000 * length // q if found else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        words, offsets, wanted = [], [0], set()
        for text in range(rng.randrange(1, 5)):
            kinds, n, own = rng.choice([1, 2, 2, 3, 9]), rng.randrange(90), []
            while len(own) < n:
                unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 12))]
                own += unit * rng.randrange(1, 8) if rng.random() < 0.4 else own[-rng.randrange(1, len(own) + 1) :] * rng.randrange(1, 6) if own and rng.random() < 0.3 else unit[:1]
            wanted |= {(s + offsets[-1], s + n + offsets[-1], q) for s, n, q in plain_runs(own[:300]) if n >= 6}
            words += [*own[:300], -1 - text]
            offsets.append(len(words))
        found = {(a, b, q) for (a, b), q in periods.runs(np.array(words), np.array(offsets)).items() if b - a >= 6}
        assert found == wanted, words


@pytest.mark.parametrize("period", [1, 3, 7, 64, 100, 2500])
def test_a_run_of_any_scale(period):
    rng = np.random.default_rng(period)
    unit = rng.integers(0, 5000, period)
    words = np.concatenate([rng.integers(0, 5000, 300), np.tile(unit, 5)[: 4 * period + 2], rng.integers(0, 5000, 100), [-1]])
    found = periods.runs(words, np.array([0, len(words)]))
    assert period in found.values() and all(b - a >= 4 * q and (words[a : b - q] == words[a + q : b]).all() for (a, b), q in found.items())


def test_synchronising_positions_hang_on_their_context_alone():
    rng = np.random.default_rng(4)
    part = rng.integers(0, 3, 200)
    words = np.concatenate([rng.integers(0, 3, 57), part, rng.integers(0, 3, 31), part])
    hashes = common.mixed(words.astype(np.uint64))
    for scale in (1, 2, 4, 8):
        at = periods.synchronising(hashes, scale, np.zeros(len(hashes), bool))
        own = [set((at[(at >= low) & (at < low + 200 - 2 * scale)] - low).tolist()) for low in (57, 288)]
        assert own[0] == own[1] and own[0]
        hashes = common.mixed(hashes[:-scale] + common.mixed(hashes[scale:] * common.MIX))


def test_runs_of_documents(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter(F.length("text") < 20000)  # the brute force is quadratic
    wanted = [plain_detect(r.doc_id, r.text) for r in docs.collect()]
    assert shown(periods.detect(docs).collect()) == shown(wanted)
    assert sum(r[1] for r in wanted) > 5
    # the longest text is one word many times over: its only run is the whole of it
    assert shown(periods.detect(odd.filter("doc_id <> 5 or doc_id is null")).collect()) == shown(plain_detect(r[0], r[1]) for r in ODD if r[0] != 5)
    long = periods.detect(odd.filter("doc_id = 5")).collect()[0]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 30000, 1)
    assert periods.detect(none).collect() == []


def test_runs_of_odd_texts(spark):
    texts = ["a b a b a b a b", "a a a a a", "a a a a a a", "A a A a A a A a A a", "a\u00a0a a\u00a0a x", "\t\n", "x " * 7 + "y " * 9, "p q r " * 40 + "p p p p p p", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 6), (3, texts[3])]
    found = periods.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    assert shown(found.collect()) == shown(plain_detect(i, t) for i, t in rows)
