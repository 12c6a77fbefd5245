"""The training-data operators against brute force on small texts with
nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("logmart.llm")

from logmart.llm import (  # noqa: E402
    chat_format,
    decontaminate,
    jaccard_join,
    line_dedup,
    packing,
    quality_llr,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    warc,
)
from logmart.llm.common import connected_components  # noqa: E402

DOCS = "doc_id long, text string, h long, n int, source string"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(seed: int, n: int = 40) -> list[tuple]:
    """Copies, near copies and shared passages; columns h, n and source
    clash with names used inside."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(3, 160))] for _ in range(5)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            w[rng.randrange(len(w))] = word().upper()
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w), 0, 0, f"s{i % 3}"))
    rows += [(900, None, 1, 1, None), (901, "", 1, 1, "x"), (902, " \n\t", 1, 1, "x"), (903, "a " * 3000, 1, 1, "x"),
             (904, "a " * 3000, 1, 1, "x"), (905, "one two", 1, 1, "x")]
    return rows


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus(1)
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (7, 7), (3, 1), (8, 5), (20, 21), (None, 2)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_jaccard(spark, docs, none):
    rows, df = docs
    sets = {}
    for i, t, *_ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df.union(df.limit(3))).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard_join.jaccard_components(none).count() == 0


def repeated(w: list[str]) -> int:
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    return len({i + k for xs in at.values() if len(xs) > 1 for i in xs for k in range(3)})


def test_quality(spark, docs, none):
    rows, df = docs
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_llr.quality(df, labels).collect()}
    for i, t, *_ in rows:
        w, r = words(t), got[i]
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.n_repeat_words == repeated(w)
        assert r.base_failed == (len(w) < 50 or 100 * repeated(w) > 50 * len(w))
        assert r.kept == (not r.base_failed and r.score >= quality_llr.THRESHOLD)
    # no label: no evidence; a filter on the verdict gives the same rows
    bare = quality_llr.quality(df, labels.limit(0))
    assert {r.score for r in bare.collect()} == {0}
    assert quality_llr.quality(df, labels).where("kept").count() == sum(r.kept for r in got.values())
    assert quality_llr.quality(none, labels).count() == 0


def test_quality_separates(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice("sun moon star sky tree".split()) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(rng.choice("buy now click win cash".split()) for _ in range(80)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score >= quality_llr.THRESHOLD for r in quality_llr.quality(df, labels).collect()}
    assert all(got[i] == (i < 60) for i in got)


def test_warc(spark, tmp_path):
    big = "é" * 60
    rows = [(3, "u", big), (1, "u\r\nX: y", big), (2, None, None), (5, "u", "short"), (4, "u", "short"), (None, "u", big),
            (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n" * 9)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path))
    got = {r.id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    for i, url, html in rows:
        assert got[i].url == (url or "")
        if i:
            assert bytes(got[i].payload) == (html or "").encode() and got[i].payload_digest == sha(html or "")
    assert (got[3].record_type, got[3].refers_to) == ("revisit", 1)
    assert all(got[i].record_type == "response" and got[i].refers_to is None for i in (1, 2, 4, 5, 6, None))
    assert bytes(got[1].record).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert spark.read.parquet(f"{tmp_path}/payloads").count() == 4


def test_warc_query_and_odd_urls(spark, tmp_path):
    """Urls come back as they were, none is read as a header field; the
    query against brute force, with repeated rows and an extra column."""
    from logmart.llm.queries import op4_warc
    html = ["x" * 100, "x" * 99, "y" * 300, None, "", "é" * 50, "é" * 49]
    urls = [f"a{c}WARC-Refers-To: <urn:page:77>{c}WARC-Payload-Digest: sha256:0" for c in "\u0085\u2028\u2029\r\n\x0b"]
    urls += ["a\r\nWARC-Type: revisit\r\n", "%0D%0A", "%250A\r", "", None, "http://x/?q=: a"]
    rows = [(i, urls[i % len(urls)], html[i % 7], "z") for i in range(70)] + [(70, "u", html[2], "z")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    warc.write(df, f"{tmp_path}/w")
    back = warc.read(spark, f"{tmp_path}/w").collect()
    assert Counter((r.id, r.url) for r in back) == Counter((i, u or "") for i, u, *_ in rows)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    first = {}
    for i, _, t, _ in rows:
        first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t, _ in rows:
        b = (t or "").encode()
        other = first[t or ""] if len(b) >= 100 and first[t or ""] != i else None
        want.append((i, len(b), sha(b), "response" if other is None else "revisit", other))
    assert Counter(map(tuple, op4_warc(spark, str(tmp_path)).collect())) == Counter(want)
    warc.write(df.limit(0), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").collect() == []


def test_lines(spark, none):
    a = "the quick brown fox jumps over the lazy dog near the old river bank today " * 3
    b = a.replace("lazy", "lazi", 1)
    rows = [(1, f"{a}\nshort line\n{b}", 0, 0, ""), (2, f"{a.upper()}!\nshort line", 0, 0, ""), (3, None, 0, 0, ""),
            (4, "", 0, 0, ""), (None, a, 0, 0, ""), (5, "an entirely different line of words here", 0, 0, "")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == (f"{a}\nshort line", 1)
    assert got[2] == ("short line", 1)
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[None] == (a, 0)
    assert got[5] == ("an entirely different line of words here", 0)
    assert line_dedup.dedup(none).count() == 0


def test_simhash(spark):
    rng = random.Random(1)
    rows = [(i, 0, " ".join(f"w{rng.randrange(500)}" for _ in range(n))) for i, n in enumerate([5, 6, 50, 255, 256, 3000])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, norm string")
    hashes = {r.w: r.x for r in df.selectExpr("explode(split(norm, ' ')) w").distinct().selectExpr("w", "xxhash64(w) x").collect()}
    for r in line_dedup.simhashes(df.unionAll(df)).collect():
        w = rows[r.doc_id][2].split(" ")
        assert r.sh == sum(1 << b for b in range(63) if 2 * sum(hashes[x] >> b & 1 for x in w) > len(w))


def test_line_families(spark):
    """Families of near lines beside each other leave one line each."""
    rng = random.Random(5)
    rows, family = [], {}
    for f in range(4):
        base = [f"w{rng.randrange(9000)}" for _ in range(150)]
        for k in range(12):
            w = list(base)
            w[rng.randrange(150)] += "x" if k else ""
            family[len(rows)] = f
            rows.append((len(rows), " ".join(w)))
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 0").collect()
    assert {family[r.doc_id] for r in out} == set(range(4)) and len(out) <= 12


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes(spark, none, seed):
    rows = [*corpus(seed), (None, "x " * 200, 0, 0, "")]
    got = {r.doc_id: r for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    seen = set()
    for i, t, *_ in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99 if i is not None else 0):
            if data[k:k + 100] in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(data[k:k + 100])
        assert bytes(got[i].kept) == bytes(c for c, g in zip(data, gone) if not g)
        assert len(got[i].spans) == len([x for x in bytes(gone).split(b"\0") if x])
    assert suffix_dedup.dedup(none).count() == 0


def test_suffix_texts_travel_deflated(spark):
    """The exchange that all joins read holds deflated bytes, the bytes left are the text's."""
    text = "one two three " * 50 + "\u017elu\u0165" * 30
    docs = spark.createDataFrame([(1, text), (2, None), (None, text)], "doc_id long, text string")
    out = suffix_dedup.dedup(docs)
    plan = out._jdf.queryExecution().analyzed().toString()
    sent = [x for x in plan.splitlines() if "RepartitionByExpression" in x]
    below = plan[plan.index(sent[0]):]
    assert "_pack" in below[:below.index("Project")]
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].n_bytes == 0 and bytes(got[None].kept) == text.encode() and got[1].n_bytes == len(text.encode())


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, none, seed):
    rows = [*corpus(seed), (None, "x " * 200, 0, 0, "")]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    seen = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49 if i is not None else 0):
            if seen.setdefault(tuple(w[k:k + 50]), i) < i:
                gone[k:k + 50] = [True] * 50
        assert (got[i].n_words, got[i].n_removed) == (len(w), sum(gone))
        assert got[i].kept_text == " ".join(x for x, g in zip(w, gone) if not g)
    assert substring_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("held", [500_000, 100])
def test_substrings_repeats_inside_texts(spark, held, monkeypatch):
    """Passages that stand many times in each text, batches cut early, and
    two texts of one id, both of which a later text repeats."""
    monkeypatch.setattr(substring_dedup, "HELD", held)
    rng = random.Random(7)
    line = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(70)) for _ in range(4)]
    rows = []
    for i in range(12):
        parts = [rng.choice(line) + rng.choice(["", " x", f" y{i}"]) for _ in range(rng.randint(1, 25))]
        rows.append((i + 2, "\n".join(parts)))
    other = [" ".join(f"{k}{j}" for j in range(90)) for k in "pq"]
    rows += [(1, other[0]), (1, other[1]), (50, "new " + other[0][9:] + " z " + other[1])]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k:k + 50]), i) < i:
                gone[k:k + 50] = [True] * 50
        if i != 1:
            assert got[i].kept_text == " ".join(x for x, g in zip(w, gone) if not g)


def test_packing_search():
    rng = random.Random(5)
    for _ in range(60):
        count = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 30)))
        got = Counter()
        patterns = packing.pack_lengths(count, 100)
        for lengths, n in patterns:
            assert sum(lengths) <= 100
            for k in lengths:
                got[k] += n
        assert got == count
        n = sum(n for _, n in patterns)
        assert packing.lower_bound(count, 100) <= n <= sum(n for _, n in packing.best_fit(count, 100))
    assert packing.pack_lengths({}) == []
    # best fit alone needs one more here
    assert sum(n for _, n in packing.pack_lengths({51: 2, 27: 2, 26: 2, 23: 2, 24: 2, 25: 2}, 100)) == 4


def test_packing(spark, none):
    tok = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = tok.path("byte_bpe_50k.json")
    enc = Tokenizer.from_file(path)
    rows = [*corpus(4), (None, "null id", 0, 0, ""), (1, "again", 0, 0, ""), (906, " a  b  c \n d'll don't ", 0, 0, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = packing.pack(packing.tokenized_pieces(df, path, capacity=64), capacity=64).collect()
    ids = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)):
        ids[r.doc_id].append(r)
    for i, t, *_ in rows:
        if i not in (None, 1):
            want = enc.encode(t or "", add_special_tokens=False).ids + [0]
            have = b"".join(bytes(r.ids) for r in ids[i])
            assert have == b"".join(x.to_bytes(4, "little") for x in want)
            assert all(r.length == 64 for r in ids[i][1:])
    place = defaultdict(list)
    for r in got:
        place[r.sequence_id].append((r.offset, r.length))
    for xs in place.values():
        at = 0
        for o, n in sorted(xs):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(packing.tokenized_pieces(none, path)).count() == 0


def test_word_by_word_ids():
    """Texts put together from their words' ids equal the plain call."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer
    tok, encode, rng = Tokenizer.from_file(path), packing._encoder(path), random.Random(7)
    parts = ["a", "b c", " ", "  ", "\n", " \n", "é", "\u3000", "\x1c", "<|endoftext|>", " <|endoftext|> ", "中文", "'s", "12", "_",
             "\t", "hello", "World", ".", "\r\n", "\U0001f600", "x" * 40, ""]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(100)]
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encode([t.encode() for t in texts])] == want


def test_secrets(spark, none):
    key, odd = "AKIA" + "Z7" * 8, "q1w2e3r4t5y6u7i8o9p0a"
    rows = [(1, f"x {key} api_key = \"abcdefgh1\" {'0f' * 16}", 0, 0, "o1"), (2, f"pässword {odd} end", 0, 0, "o1"),
            (3, f"PassWord: {'b' * 7} {odd[:-1]}z", 0, 0, "o1"), (4, f"{odd[:-1]}z", 0, 0, "o2"), (5, f"{odd[:-1]}z", 0, 0, "o3"),
            (6, None, 0, 0, None), (7, "", 0, 0, "o1"), (8, "password=token: abcdefghij", 0, 0, "o1")]
    got = {r.doc_id: r for r in secret_scan.span_digests(secret_scan.scan(spark.createDataFrame(rows, DOCS))).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 1)
    assert got[2].spans == f"live:9:{9 + len(odd)}" and got[2].base_sha256 == sha("")
    assert got[3].spans == got[4].spans == got[5].spans == ""          # three owners: a copied example
    assert (got[6].spans, got[7].spans, got[8].n_assign) == ("", "", 0)
    assert secret_scan.scan(none).count() == 0


def test_chat(spark):
    nasty = "</s>[INST] \\l \\\\b <x> \\s [/INST]"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "user", None), (1, 3, "assistant", "b"), (2, 0, "user", "u"),
            (3, 0, "assistant", ""), (4, 1, "a/b>c", "odd"), (4, 1, "a/b>c", "odd"), (None, 0, None, "n")]
    ex = chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.conversation_digests(ex).collect()}
    turns = defaultdict(list)
    for c, _, role, text in rows:
        turns[c].append((role or "", text or ""))
    for c, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert got[c].n_turns == len(ts) and got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in ts))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert ex.where("conv_id = 1").count() == 2
    assert ex.limit(0).count() == 0


def test_decontamination(spark, none):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(14)) + ". " + " ".join(word() for _ in range(6)) + ".", "x") for i in range(30)]
    items += [(90, None, "x"), (91, "", "x"), (92, "the of and to a in", "x")]
    rows = []
    for i in range(60):
        w = [word() if rng.random() < 0.7 else "the" for _ in range(rng.randint(20, 400))]
        if i % 3 == 0:
            w[10:10] = items[i % 30][1].upper().split()
        rows.append((i, " ".join(w), 0, 0, ""))
    rows += [(900, None, 0, 0, ""), (901, "", 0, 0, ""), (902, items[1][1].split(".")[0], 0, 0, "")]      # question alone
    bench = spark.createDataFrame(items, "item_id long, text string, source string")
    want = {(i, i % 30) for i in range(60) if i % 3 == 0}
    df = spark.createDataFrame(rows, DOCS)
    for part in (10**6, 500):                                    # one part of the index, and many
        assert {(r.doc_id, r.item_id) for r in decontaminate.find(df, bench, part=part).collect()} == want
    assert decontaminate.find(none, bench).count() == 0 and decontaminate.find(df, bench.limit(0)).count() == 0


def test_wand_bound_is_exact():
    """Blocks that the bound skips hold no item at the threshold."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, [rng.choice(vocab[: rng.choice([8, 60])]) for _ in range(9)], [rng.choice(vocab) for _ in range(4)]) for i in range(40)]
    df = Counter(t for _, q, a in items for t in set(q + a))
    index = decontaminate.Index(items, df, len(items), 13.0, 0.5)
    for _ in range(40):
        doc = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        open_ = set(index.open_blocks(doc, 16))
        for p in range(len(doc) // 16 + 1):
            have = set(doc[p * 16:(p + 2) * 16])
            for i, one in enumerate(index.impacts):
                if sum(x for t, x in one.items() if t in have) >= 0.5:
                    assert (p, i // decontaminate.BLOCK) in open_


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_repeated_rows(spark, seed):
    """Rows read twice or three times: their bytes start at the same place."""
    rows = corpus(seed)
    again = spark.createDataFrame(rows + rows[:7] + rows[3:9] + rows[-3:], DOCS)
    got = defaultdict(list)
    for r in suffix_dedup.dedup(again).collect():
        got[r.doc_id].append((bytes(r.kept), r.n_removed))
    once = {r.doc_id: (bytes(r.kept), r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(set(x) == {once[i]} for i, x in got.items())
    assert sum(map(len, got.values())) == again.count()
    alone = spark.createDataFrame([(1, "abcdefghi " * 9 + "z" * 99, 0, 0, "")] * 2, DOCS)
    assert all(r.n_removed == 0 for r in suffix_dedup.dedup(alone).collect())


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_recall(spark):
    """Nearly all pairs of edit similarity 0.9 are found at 5-40 words, also
    in scripts without spaces; no pair below it is."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows, near = [], {}
    for n in (5, 6, 8, 10, 15, 20, 40, "han"):
        for k in range(30):
            if n == "han":
                a = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(30))
            else:
                a = " ".join(rng.choice(vocabulary) for _ in range(n))
            c, edits = list(a), max(1, len(a) // 10 // (k % 3 + 1))
            if k % 2 and n != "han":            # one word
                w = a.split(" ")
                w[rng.randrange(n)] = rng.choice(vocabulary)
                b = " ".join(w)
            else:
                for at in rng.sample([i for i in range(len(c)) if c[i] != " "], edits):
                    c[at] = "q"
                b = "".join(c)
            near[len(rows) + 1] = n, 10 * distance(a, b) <= max(len(a), len(b))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[i] for i in got if i % 2 == 0 or not near[i][1])
    for n in {n for n, _ in near.values()}:
        found = [got[i] for i, (m, x) in near.items() if m == n and x]
        assert len(found) >= 8 and sum(found) >= 0.93 * len(found), n


def test_short_lines(spark, tmp_path):
    """Equal lines of any length go in the query and in the pipeline's stage; blank lines stay."""
    import corpus_pipeline
    from logmart.llm.queries import op5_line_dedup

    rows = [(1, "Home\n\n----\n你好世界\nRead more"), (2, "home!\n\n---- \nnew\n你好世界"), (3, "Read more\n你好世界"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, sha(rows[0][1])), 2: (3, sha("\nnew")), 3: (2, sha("")), 4: (0, None), 5: (0, sha(""))}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_duplicates(spark, df, "").collect()} == {
        1: rows[0][1], 2: "\nnew", 4: None, 5: ""}


def test_near_duplicates_stage(spark):
    """Rows without an id stay, of repeated rows one."""
    import corpus_pipeline

    text = "one two three four five six seven eight nine"
    rows = [(1, text), (1, text), (2, text), (3, "something else is written in this one"), (None, text), (None, text), (4, None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter(map(tuple, out)) == Counter([rows[0], rows[3], rows[4], rows[5], rows[6]])


def test_pipeline_stages(spark, tmp_path):
    """Quality rules, decontamination, packing and the whole run: columns with
    the operators' own names come back unchanged, and rows without an id or
    with a repeated one are judged by their own text."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = "Which stone lies under the oldest bridge of the northern harbour town of Veld? Answer: the grey basalt slab of Orrin"
    clean = [(i, text(80), i, 7, i % 2 == 0, i, "x") for i in range(8)]
    leak = [(None, f"{text(60)} {item} {text(60)}", 1, 7, False, 2, "y"), (3, f"{text(50)} {item} {text(50)}", 1, 7, False, 2, "y")]
    odd = [(20, None, 1, 7, True, 1, None), (None, "", 1, 7, None, 1, "z")]
    names = "doc_id long, text string, n_words int, score int, kept boolean, n_removed int, __x string"
    df = spark.createDataFrame(clean + leak + odd, names)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = lambda d: Counter(map(tuple, d.collect()))
    path = str(tmp_path)

    out = corpus_pipeline.quality_rules(spark, df, path)
    assert out.columns == df.columns and not rows(out) - rows(df)
    assert all(r.text and len(r.text.split()) >= 50 for r in out.collect())
    lines = corpus_pipeline.line_duplicates(spark, df, path)
    assert lines.columns == df.columns and rows(lines) == rows(df)
    assert rows(corpus_pipeline.leaks(spark, df, path)) == Counter(clean + odd)

    pieces = corpus_pipeline.run(spark, path).collect()
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, df, path).collect() if item not in r.text}
    # of the two rows with id 3 the Jaccard stage keeps one
    assert {r.doc_id for r in pieces} - {3} == kept - {3} and len(kept) > 2
    at = defaultdict(list)
    for r in pieces:
        at[r.sequence_id].append((r.offset, r.length))
    for got in at.values():
        ends = [a + n for a, n in sorted(got)]
        assert [a for a, _ in sorted(got)] == [0, *ends[:-1]] and ends[-1] <= 2048
