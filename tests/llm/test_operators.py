import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.llm import audio, bpe, common, jaccard, langid, mixing, quality, queries, sharding, tokenfile, toxicity, urls

P = pytest.importorskip("public_tokenizers")


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# --- quality rules ---------------------------------------------------------


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark, docs):
    extra = ["a b c d e " * 4, "x y z a b c d e q a b c d e", "one two three four five", "one two three four five one two three four five"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = quality.judge_quality(df, []).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    for r in got:
        assert tuple(r[1:6]) == counts(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_list_covers_what_was_planted():
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        f = {k: rng.random() * 0.1 for k in quality.FEATURES}
        f |= {"symbol_ratio": 0.5 + rng.random() if bad else rng.random() * 0.3, "fold": i % 4 % 3, "label": int(not bad)}
        rows.append(f)
    rules = quality.learn_list(rows)
    assert rules and all((any(r.holds(x) for r in rules)) == (x["label"] == 0) for x in rows)
    assert quality.learn_list([r for r in rows if r["label"]]) == []


def test_quality_empty(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_rules(nothing, labels) == []
    assert quality.judge_quality(nothing, []).count() == 0


# --- sharding --------------------------------------------------------------


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 97, 1000])
def test_jump_hash(spark, n):
    keys = [0, 1, -1, 7, 2**40, -(2**63), 2**63 - 1, *range(1000, 1200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n, n + 1).alias("s"))
    for r in df.collect():
        assert (r.s.shard, r.s.other) == (jump(r.k, n), jump(r.k, n + 1))
        assert r.s.other in (r.s.shard, n)


def test_shards(docs, nothing):
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == [*range(len(v))] for v in slots.values())
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(docs))
    assert sizes == Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert sharding.assign_shards(nothing).count() == 0


# --- URL filter ------------------------------------------------------------


def test_cascade_is_exact(spark):
    rng = random.Random(2)
    keys = [f"h{rng.randrange(10**9)}.example" for _ in range(3000)]
    listed = spark.createDataFrame([(k,) for k in sorted(set(keys[:200]))], "key string")
    universe = spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string")
    cascade = urls.build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    got = {r.key for r in universe.filter(cascade.has(F.col("key"))).collect()}
    assert got == set(keys[:200])
    assert not urls.build_cascade(listed.limit(0), universe).levels


def test_cascade_of_many_keys(spark):
    """A fifth of a million keys is listed; every answer is right, and the plan's text does not hold the bits."""
    universe = spark.range(1_000_000).select(F.concat(F.lit("host"), F.col("id"), F.lit(".example")).alias("key"))
    listed = spark.range(0, 1_000_000, 5).select(F.concat(F.lit("host"), F.col("id"), F.lit(".example")).alias("key"))
    cascade = urls.build_cascade(listed, universe)
    found = spark.range(1_000_000).select("id", F.concat(F.lit("host"), F.col("id"), F.lit(".example")).alias("key")).select("id", cascade.has(F.col("key")).alias("x"))
    assert found.filter(F.col("x") != (F.col("id") % 5 == 0)).count() == 0
    assert len(cascade.levels) > 5 and len(found._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_cascade_size_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_BITS", 64)
    keys = spark.range(100).select(F.col("id").cast("string").alias("key"))
    with pytest.raises(ValueError, match="beyond"):
        urls.build_cascade(keys.limit(50), keys)


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.NET/x": ("a.net", "/x", "net/", "block"),
        "http://www.example.net/en/1?q": ("www.example.net", "/en/1", "example.net/en/", "allow"), "http://net": ("net", "", None, "allow"),
        "http://x.adult-x.example.com/fr/": ("x.adult-x.example.com", "/fr/", None, "block"), "http://adult-x.example.com#/de/": ("adult-x.example.com", "", None, "block"),
        "http://a.org/fr/x#y": ("a.org", "/fr/x", "org/fr/", "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("adult-x.example.com",), ("adult-x.example.com",), (None,)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, listed).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge_urls(pages.limit(0), listed).count() == 0


# --- BPE and token files ---------------------------------------------------


def odd_texts(docs):
    rng = random.Random(3)
    alphabet = "aab  \t\n\x1c\x85\u00a0\u2003.,'12éßΑ漢🙂\u0301<|endoftext|>"
    return [t for _, t in texts(docs)] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)] + ["x" * 5000, "the" * 3000]


def test_bpe_matches_library(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    all_ = odd_texts(docs)
    df = spark.createDataFrame([*enumerate(all_)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = bpe.bpe_round_trip(df, path)
    for r in coded.select("text", "ids", "decoded", *(c.alias(k) for k, c in bpe.digests(coded).items())).collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
    assert bpe.bpe_round_trip(df.limit(0), path).count() == 0


def test_merge_order():
    b = bpe.ByteBpe(P.path("byte_bpe_50k.json"))

    def plain(ids):
        while True:
            found = [(b.pairs[x << 32 | y][0], i) for i, (x, y) in enumerate(zip(ids, ids[1:])) if (x << 32 | y) in b.pairs]
            if not found:
                return ids
            i = min(found)[1]
            ids = [*ids[:i], b.pairs[ids[i] << 32 | ids[i + 1]][1], *ids[i + 2 :]]

    rng = random.Random(4)
    for _ in range(300):
        ids = [b.first[x] for x in "".join(rng.choice("theinranaa") for _ in range(rng.randrange(1, 30))).encode()]
        assert b.merge([*ids]) == plain(ids)


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    df = spark.createDataFrame([*enumerate(odd_texts(docs))], "doc_id long, text string")
    manifest = tokenfile.write_token_files(df, f"file://{tmp_path}/t", path, length=64)
    got = tokenfile.read_token_files(spark, manifest).orderBy("doc_id").collect()
    start = 0
    for r, (_, t) in zip(got, sorted(texts(df))):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
    shard = tokenfile.Shard(manifest.orderBy("shard").first().path)
    assert len(shard.sequence(0)) == 64 and shard.sequence(0).base is not None
    assert sum(sum(shard.mask(i).to_pylist()) for i in range(len(shard))) == manifest.orderBy("shard").first().tokens
    empty = tokenfile.write_token_files(df.limit(0), f"file://{tmp_path}/e", path)
    assert tokenfile.read_token_files(spark, empty).count() == 0


def test_words_of_one_stem_are_encoded_once(monkeypatch):
    """Case and marks behind a word cost no second encoding; whatever else a word holds, ids are the library's."""
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(9)
    lib, enc, asked = Tokenizer.from_file(path), tokenfile.WordEncoder(path), []
    want = lambda t: np.array(lib.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes()
    by_word, by_stem = enc._ids, enc._stems
    monkeypatch.setattr(enc, "_ids", lambda x: asked.extend(x) or by_word(x))
    monkeypatch.setattr(enc, "_stems", lambda x: asked.extend(x) or by_stem(x), raising=False)
    text = "Straße straße, STRASSE strasse. (Straße) STRAßE! straße... übung Übung, ÜBUNG."
    assert enc.encode([text, "Übung! strasse,"]) == [want(text), want("Übung! strasse,")]
    assert sorted(x for x in asked if x[0].isalpha()) == ["strasse", "straße", "übung"]
    monkeypatch.undo()
    parts = ["ab", "Zoo", "É", "e\u0301", "ñ", "İ", "ı", "ß", "ẞ", "ΟΔΟΣ", "σ", "ж", "\u212a", "\u212b", "ª", "µ", "ǅ", "ŉ", "ƻ", "ǃ", "\u2c7e", "\u0338", "\u0307", "ﬁ", "字", "½", "²", "7", "42", "'s", "'LL", "’s", "'", "_", "-", ".", ",", "=", "<", ">", "|", "…", "¿", "🙂", "\u200d", "\u00ad", "\x00", "\x85", "\u3000", "\ufeff", "\ud7ff"]
    words = ["".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(4000)] + [a + b for a in parts for b in parts] + [x + "," for x in map(chr, range(33, 0x250))]
    for cache in (0, 50, 400_000):
        monkeypatch.setattr(tokenfile, "CACHE", cache)
        enc = tokenfile.WordEncoder(path)
        texts = [" ".join(rng.choices(words, k=30)) for _ in range(300)] + words
        for k in range(0, len(texts), 256):
            assert enc.encode(texts[k : k + 256]) == [want(t) for t in texts[k : k + 256]]
    assert enc.last is not None and tokenfile.WordEncoder(P.path("byte_bpe_50k.json")).last is None


def test_kept_words_are_bounded(monkeypatch):
    """A view of many words does not take the cache past its bound, and later words have right ids."""
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(3)
    lib = Tokenizer.from_file(path)
    monkeypatch.setattr(tokenfile, "CACHE", 100)
    enc = tokenfile.WordEncoder(path)
    for _ in range(3):
        text = " ".join("".join(rng.choices("abcdeé", k=6)) + rng.choice(["", "!"]) for _ in range(2000))
        assert enc.encode([text]) == [np.array(lib.encode(text, add_special_tokens=False).ids, enc.dtype).tobytes()]
        assert (len(enc.cache), len(enc.stems)) == (100, 100)


def test_words_of_a_view_are_handled_once():
    """Python's work grows with the distinct words of a view, not with its texts; every kind of white space parts words."""
    import sys

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, enc, calls = Tokenizer.from_file(path), tokenfile.WordEncoder(path), []
    want = lambda t: np.array(lib.encode(t or "", add_special_tokens=False).ids, enc.dtype).tobytes()
    views = [[f"one two, {'three! ' * (i % 3)}Four" for i in range(n)] for n in (3, 3000)]
    right = [[*map(want, v)] for v in views]
    enc.encode(views[0])
    for view, ids in zip(views, right):
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)  # noqa: B023
        try:
            got = enc.encode(view)
        finally:
            sys.setprofile(None)
        assert got == ids
        calls.append(len(seen))
    assert calls[1] < calls[0] + 100
    spaces = [chr(c) for c in range(1, 0x110000) if chr(c).isspace()]
    assert len(spaces) == 29 and enc.encode([f"a{c}B{c}{c}c." for c in spaces]) == [want(f"a{c}B{c}{c}c.") for c in spaces]
    # texts that go through the library whole, nulls and texts without words, first, last and side by side
    odd = ["<|endoftext|> x", "a\x1cb", None, "", " ", "a b", "a\x1fb", "<|", None, "ab <|startoftext|>", "last"]
    for texts in (odd, odd[::-1], odd[:1], odd[2:3], []):
        raw, sizes = enc.pack(pa.array(["cut off", *texts], pa.string())[1:], b"\x02\x00")
        assert bytes(raw) == b"".join(want(t) + b"\x02\x00" for t in texts)
        assert sizes.tolist() == [len(want(t)) // 2 + 1 for t in texts]
    assert enc.encode([]) == [] and enc.encode(["", " "]) == [b"", b""]


# --- audio -----------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 64, 1005, 1006, 1007, 50_000])
def test_audio_round_trip(n):
    payload = random.Random(n).randbytes(n)
    x = audio.parse(audio.pack(payload, "note"))
    assert audio.carried(x) == payload
    assert x["crc_bad"] == x["skipped"] == x["resyncs"] == 0
    assert x["table"]["frames"] == len(x["offsets"]) and x["samples"] == 1152 * len(x["offsets"])


def test_audio_damage():
    good = audio.pack(b"abc" * 2000)
    x = audio.parse(good)
    cut = x["offsets"][2]
    y = audio.parse(good[:cut] + b"\xff\xfb junk \xff" * 9 + good[cut:] + b"TAG" + bytes(125))
    assert len(y["offsets"]) == len(x["offsets"]) and y["skipped"] == 81 and y["resyncs"] == 1
    z = audio.parse(good[: cut + 10] + b"\x55" + good[cut + 11 :])
    assert z["crc_bad"] == 1 and len(z["offsets"]) == len(x["offsets"])
    assert audio.parse(b"")["offsets"] == [] and audio.parse(b"\xff" * 1000)["offsets"] == []


def bits_of(text):
    return int(text, 2).to_bytes(len(text) // 8, "big")


def plain_crc(bits):
    """The remainder of the checksum, a bit at a time."""
    c = 0xFFFF
    for b in bits:
        c = (c << 1) ^ (0x8005 if (c >> 15 & 1) ^ int(b) else 0)
        c &= 0xFFFF
    return c


def protected(head, allocation, covered, size):
    """A frame of ``size`` bytes: header, checksum over the header's second half and ``covered`` bits, then the allocation."""
    crc = plain_crc("".join(f"{b:08b}" for b in head[2:4]) + covered)
    body = allocation + "0" * (-len(allocation) % 8)
    return (head + crc.to_bytes(2, "big") + bits_of(body)).ljust(size, b"\x11")


def test_checksums_of_layers_one_and_two():
    rng = random.Random(17)
    # layer I, 44 100 Hz, 128 kbit/s, joint stereo from subband 8 on: 8 * 2 + 24 fields of four bits
    head = bytes((0xFF, 0xFE, 0x40, 0x50))
    alloc = "".join(rng.choice("01") for _ in range(4 * 40))
    one = protected(head, alloc, alloc, (12000 * 128 // 44100) * 4)
    x = audio.parse(one * 3)
    assert (x["layer"], len(x["offsets"]), x["crc_good"], x["crc_bad"], x["samples"]) == (1, 3, 3, 0, 1152)
    # layer II, 48 000 Hz, 64 kbit/s, one channel: 27 subbands, and two bits for each that is used
    head = bytes((0xFF, 0xFC, 0x44, 0xC0))
    fields = [(4, rng.randrange(16)) for _ in range(11)] + [(3, rng.randrange(8)) for _ in range(12)] + [(2, rng.randrange(4)) for _ in range(4)]
    alloc = "".join(f"{v:0{n}b}" for n, v in fields)
    choice = "".join(rng.choice("01") for _ in range(2 * sum(v > 0 for _, v in fields)))
    two = protected(head, alloc + choice, alloc + choice, 144 * 64000 // 48000)
    x = audio.parse(two * 4)
    assert (x["layer"], len(x["offsets"]), x["crc_good"], x["crc_bad"], x["channels"]) == (2, 4, 4, 0, 1)
    broken = bytearray(two)
    broken[7] ^= 4
    assert audio.parse(two + bytes(broken) + two)["crc_bad"] == 1
    # layer II of MPEG-2 at 16 000 Hz, 32 kbit/s, two channels: 30 subbands
    head = bytes((0xFF, 0xF4, 0x48, 0x00))
    fields = [(n, rng.randrange(1 << n)) for count, n in ((4, 4), (7, 3), (19, 2)) for _ in range(2 * count)]
    alloc = "".join(f"{v:0{n}b}" for n, v in fields)
    choice = "".join(rng.choice("01") for _ in range(2 * sum(v > 0 for _, v in fields)))
    low = protected(head, alloc + choice, alloc + choice, 144 * 32000 // 16000)
    x = audio.parse(low * 2)
    assert (x["version"], x["rate"], x["crc_good"], x["crc_bad"]) == ("2", 16000, 2, 0)


def test_free_format_and_low_rates():
    head = bytes((0xFF, 0xFB, 0x00, 0xC0))
    frame = head + bytes(17) + bytes(300 - 21)
    padded = bytes((0xFF, 0xFB, 0x02, 0xC0)) + bytes(17) + bytes(301 - 21)
    x = audio.parse(frame + padded + frame + frame)
    assert x["offsets"] == [0, 300, 601, 901] and x["samples"] == 4 * 1152 and x["skipped"] == 0
    # MPEG-2.5, layer III, 8 000 Hz, 8 kbit/s, one channel: 576 samples a frame
    low = bytes((0xFF, 0xE3, 0x18, 0xC0)).ljust(72, b"\0")
    x = audio.parse(low * 5)
    assert (x["version"], x["rate"], x["samples"], len(x["offsets"])) == ("2.5", 8000, 5 * 576, 5)


def test_tables_and_tags():
    frame = bytes((0xFF, 0xFB, 0x90, 0x00)).ljust(417, b"\0")
    xing = bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(32) + b"Info" + (15).to_bytes(4, "big") + (3).to_bytes(4, "big") + (4096).to_bytes(4, "big") + bytes(range(100)) + (57).to_bytes(4, "big") + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    v1 = b"TAG" + b"A title".ljust(30, b"\0") + b"Someone".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07" + b"\x11"
    x = audio.parse(xing.ljust(417, b"\0") + frame * 3 + v1)
    t = x["table"]
    assert (t["frames"], t["quality"], t["delay"], t["padding"], t["seek"][50]) == (3, 57, 576, 1000, 50 * 4096 // 256)
    assert {k: v for k, v in x["tags"].items()} == {"v1:title": "A title", "v1:artist": "Someone", "v1:year": "1999", "v1:comment": "note", "v1:track": "7", "v1:genre": "17"}
    vbri = bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(32) + b"VBRI" + bytes((0, 1, 0, 0, 0, 75)) + (9000).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"".join(n.to_bytes(2, "big") for n in (3, 10, 2, 1, 41, 42, 40))
    t = audio.parse(vbri.ljust(417, b"\0") + frame * 3)["table"]
    assert (t["kind"], t["bytes"], t["frames"], t["quality"], t["seek"]) == ("VBRI", 9000, 3, 75, [410, 830, 1230])
    old = b"TT2" + (6).to_bytes(3, "big") + b"\0Short" + b"TXX" + (10).to_bytes(3, "big") + b"\0key\0value"
    tag = b"ID3\x02\0\0" + bytes((0, 0, 0, len(old))) + old
    assert audio.parse(tag + frame * 2)["tags"] == {"TT2": "Short", "TXXX:key": "value"}
    spread = b"TIT2" + (7).to_bytes(4, "big") + b"\0\0" + b"\0a\xff\0bcd\xff\0"
    tag = b"ID3\x03\0\x80" + bytes((0, 0, 0, len(spread))) + spread
    assert audio.parse(tag + frame * 2)["tags"] == {"TIT2": "a\xffbcd\xff"}


def test_audio_columns(docs, nothing):
    out = audio.read_audio(audio.text_to_audio(docs.select("doc_id", "text", F.lit(1).alias("info")))).collect()
    for r in out:
        n = int(r.info.tags["TXXX:payload"].partition(";")[0])
        assert bytes(r.info.body[:n]) == audio.pad64((r.text or "").encode())
    assert audio.read_audio(audio.text_to_audio(nothing)).count() == 0


# --- similar documents -----------------------------------------------------


def brute_force(rows):
    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    by = defaultdict(list)
    for i, t in rows:
        if shingles(t):
            by[t].append(i)
    keys, sets = [*by], [shingles(t) for t in by]
    links, parent = defaultdict(set), [*range(len(keys))]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i, t in enumerate(keys):
        least[root(i)] = min(least[root(i)], *by[t]) if by[t] else 0
    return sorted((x, least[root(i)], min(by[t]), len(by[t]), len(links[i]), sum(len(by[keys[j]]) for j in links[i])) for i, t in enumerate(keys) for x in by[t])


def test_similar_documents(spark, docs, nothing, monkeypatch):
    rng = random.Random(5)
    rows = [(i, t) for i, t in texts(docs) if i is not None]
    for base in range(4):
        words = [f"b{base}w{i}" for i in range(rng.choice((40, 200)))]
        for k in range(40):
            w = [*words]
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] += "s"
            rows.append((1000 + base * 100 + k, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.similar_documents(df).collect())
    wordless = sorted((i, i, i, 1, 0, 0) for i, t in rows if not (t or "").strip(" \t\n"))
    assert got == sorted(brute_force(rows) + wordless)
    assert jaccard.similar_documents(docs).count() == docs.count()
    assert jaccard.similar_documents(nothing).count() == 0


def test_null_ids_and_repeated_rows_link_like_others(spark):
    rng = random.Random(15)
    base = [f"w{i}" for i in range(60)]
    near = lambda: " ".join(w + "x" * (i == 30 + rng.randrange(3)) for i, w in enumerate(base))
    rows = [(None, near()) for _ in range(40)] + [(None, " ".join(base))] * 30 + [(5, " ".join(base)), (5, "other words of another row here now"), (4, near())]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and Counter(r.class_id for r in got) == {4: 72, 5: 1}
    numbered = sorted(brute_force([(k, t) for k, (_, t) in enumerate(rows)]))
    assert sorted((r.n_copies, r.n_links, r.n_linked_docs) for r in got) == sorted(r[3:] for r in numbered)


def test_pieces_have_all_shingles(monkeypatch):
    rng = random.Random(16)
    for size in (30, 57, 400):
        monkeypatch.setattr(jaccard, "PIECE", size)
        for n in (0, 1, 3, 4, 5, 6, 40, 300):
            text = "".join(rng.choice(" \t\n\x0b") * rng.randrange(1, 4) + "wé" * rng.randrange(1, 30 if n < 6 else 8) + str(rng.randrange(9)) for _ in range(n)) + " " * rng.randrange(70)
            raw = text.encode()
            whole = jaccard.shingle_hashes([raw])[0]
            assert set(jaccard.shingle_array(text).tolist()) == set(whole.tolist())
            sig, some = jaccard.signatures([raw])
            monkeypatch.setattr(jaccard, "PIECE", 1 << 20)
            want, has = jaccard.signatures([raw])
            monkeypatch.setattr(jaccard, "PIECE", size)
            assert (some == has).all() and (sig == want).all()


def test_long_texts_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", 3000)
    words = [f"long{i * 7919 % 3001}" for i in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:880])), (3, " ".join(words[:300])), (4, " ".join(words[:290])), (5, " ".join(words[450:]))]
    # one process runs the tests: forked workers have the smaller piece too
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0)}


def test_no_link_of_the_documents_is_lost(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op10_jaccard_join(spark, sf_dir).collect())
    assert got == sorted(brute_force(rows) + [(i, i, i, 1, 0, 0) for i, t in rows if not (t or "").strip(" \t\n\r\x0b\x0c")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, x) for x in range(501, 560)] + [(900, 900)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in jaccard.components(df).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {x: 500 for x in range(501, 560)}


def test_least_matches():
    m = jaccard.least_matches()
    assert len(m) == jaccard.VALUES // jaccard.STEP and m == sorted(m) and m[-1] < 0.8 * jaccard.VALUES


# --- mixing ----------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(2000):
        p = rng.betavariate(0.5, 0.5)
        rows.append((i, rng.randrange(0, 300), [p, 1 - p]))
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    total = sum(r[1] for r in rows)
    mix = mixing.fit_rates(df, [0.8 * total, 0.2 * total])
    got = df.withColumn("rate", mix.rate("posterior"))
    assert got.filter("rate < 0").count() == 0
    sums = got.selectExpr("sum(rate * n_tokens * posterior[0])", "sum(rate * n_tokens * posterior[1])").first()
    assert sums[0] == pytest.approx(0.8 * total, rel=1e-3) and sums[1] == pytest.approx(0.2 * total, rel=1e-2)
    assert mixing.fit_rates(df.limit(0), [0.0, 0.0]).steps == []


def test_unreachable_targets_are_told(spark):
    """Every row is half of each domain, so that 0.9 to 0.1 cannot be had."""
    df = spark.createDataFrame([(i, 10, [0.5, 0.5]) for i in range(20)], "doc_id long, n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="targets not met"):
        mix = mixing.fit_rates(df, [180.0, 20.0], rounds=2)
    assert not mix.met and mix.targets == [180.0, 20.0] and sum(mix.expected) == pytest.approx(200)
    assert mixing.fit_rates(df, [120.0, 120.0], rounds=2).met
    assert queries.WEIGHTS == {"quality=1 toxic=0": 0.90, "quality=0 toxic=0": 0.07, "quality=1 toxic=1": 0.02, "quality=0 toxic=1": 0.01}


def nearest_rates(p, n, t):
    """The rates >= 0 nearest to 1 (by tokens) with totals t, by a general solver's slow road: its dual, by gradients."""
    slope, mass = np.zeros(len(t)), (p * n[:, None]).sum(0)
    for _ in range(60_000):
        slope += ((np.maximum(0, 1 - p @ slope) * n) @ p - t) / mass
    return np.maximum(0, 1 - p @ slope)


def test_rates_of_four_domains_match_a_plain_solver(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet((0.3, 0.3, 0.3, 0.3), 400)
    n = rng.integers(0, 200, 400)
    share = np.array([0.62, 0.2, 0.15, 0.03])  # far from what there is: some rates are 0
    df = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(400)], "doc_id long, n_tokens long, posterior array<double>")
    mix = mixing.fit_rates(df, (share * n.sum()).tolist())
    want = nearest_rates(p, n.astype(float), share * n.sum())
    got = np.array([r.rate for r in df.withColumn("rate", mix.rate("posterior")).orderBy("doc_id").collect()])
    assert mix.met and (want == 0).any() and np.abs(got - want).max() < 1e-4
    assert (got * n) @ p == pytest.approx(share * n.sum(), rel=1e-5)


def test_out_of_reach_is_approached(spark):
    """No mix of these rows has more than 0.8 of the first domain: the fit ends near the best there is."""
    rows = [(i, 10, [0.8, 0.2] if i % 2 else [0.3, 0.7]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="targets not met"):
        mix = mixing.fit_rates(df, [380.0, 20.0])
    rates = {tuple(r.posterior): r.rate for r in df.withColumn("rate", mix.rate("posterior")).collect()}
    # least squares over the mass of the domains (220 and 180): all from the first kind of row
    best = (0.8 * 380 / 220 + 0.2 * 20 / 180) / (0.8**2 / 220 + 0.2**2 / 180) / 200
    assert rates[0.3, 0.7] == pytest.approx(0, abs=1e-4) and rates[0.8, 0.2] == pytest.approx(best, rel=1e-3)


def test_posteriors_match_brute_force(spark, docs):
    model = mixing.Classifier(["a", "b", "c"], [0.5, -0.25, 0.0], {"1:idiot": [2.0, -1.0, 0.5], "2:w": [0.0, 0.0, 1.0], "2:the": [-1.0, 0.25, 3.0], "#length:0": [0.5, 0.0, -0.5], "#length:2": [0.25, 1.0, -2.0], "#upper:0": [0.0, -3.0, 0.0]})
    rows = mixing.score_domains(docs, model).select("doc_id", "n_tokens", "posterior").collect()
    by = {(r.doc_id, r.n_tokens): r.posterior for r in rows}
    for i, t in texts(docs):
        words = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        starts = Counter(x[:5] for x in re.split(r"[^\w]+|_", (t or "").lower()) if x)
        have = {f"1:{x}" for x in starts} | {f"2:{x}" for x, n in starts.items() if n > 1}
        have |= {f"#length:{sum(np.log10(max(len(words), 1)) >= b for b in mixing.BINS['length'][1])}", f"#upper:{sum(sum(map(str.isupper, t or '')) / max(len(''.join(words)), 1) >= b for b in mixing.BINS['upper'][1])}"}
        z = np.array(model.constant) + sum((np.array(w) for f, w in model.weights.items() if f in have), np.zeros(3))
        assert by[i, len(words)] == pytest.approx((np.exp(z) / np.exp(z).sum()).tolist()), t


def test_regression_is_calibrated():
    rng = np.random.default_rng(9)
    x = rng.random((3000, 6)) < 0.3
    y = (x[:, 0].astype(int) + 2 * (rng.random(3000) < 0.2 + 0.6 * x[:, 1])).astype(int)
    w = mixing.regression([(int(d), np.flatnonzero(r).tolist()) for d, r in zip(y, x)], 4, 6)
    z = np.column_stack([x, np.ones(3000)]) @ w.T
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert p.sum(0) == pytest.approx(np.bincount(y, minlength=4), rel=1e-3)
    assert p[x[:, 1] & x[:, 0]].mean(0)[3] == pytest.approx(0.8, abs=0.05)


def test_copies_have_the_rate_as_mean(spark):
    rows = spark.range(20_000).select("id", F.lit(1.3).alias("r")).select(mixing.copies(F.col("r"), "id").alias("n"))
    found = {r.n: r["count"] for r in rows.groupBy("n").count().collect()}
    assert set(found) == {1, 2} and found[2] / 20_000 == pytest.approx(0.3, abs=0.02)


def test_domains(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else 0) for i in range(14)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    model, mix, scored = mixing.mix_rates(docs, labels, queries.label_domain(), queries.WEIGHTS)
    assert scored.count() == docs.count()
    for r in scored.withColumn("rate", mix.rate("posterior")).collect():
        assert sum(r.posterior) == pytest.approx(1) and r.rate >= 0
    model, mix, scored = mixing.mix_rates(nothing, labels.limit(0), queries.label_domain(), queries.WEIGHTS)
    assert scored.count() == 0 and mix.steps == []


def test_posteriors_are_written_in_few_files(spark, sf_dir, tmp_path, monkeypatch):
    """A folder, file and checksum of a small task each cost an executor a child: no more files than cores."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    many = docs.repartition(64)
    assert common.few(many).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    _, mix, scored = mixing.mix_rates(many, labels, queries.label_domain(), queries.WEIGHTS)
    assert scored.count() == docs.count()
    assert len([*tmp_path.glob("sitewise/*/part-*")]) <= spark.sparkContext.defaultParallelism
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


# --- classifiers -----------------------------------------------------------


def test_language(spark, docs, nothing, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_centroids(table)
    got = langid.identify(table, model).filter("lang_pred = lang").count()
    assert got >= 0.97 * table.count()
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].rejected for i in (1, 2, 3, 9))
    assert all(0 <= r.score <= 1 for r in rows.values())
    nobody = langid.fit_centroids(nothing)
    assert {r.lang_pred for r in langid.identify(docs, nobody).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


def test_blocks_count_like_whole_texts(monkeypatch):
    text = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(500))
    whole = langid.count_vectors([text])
    monkeypatch.setattr(langid, "BLOCK", 300)
    assert (langid.count_vectors([text]) == whole).all()


def test_toxicity(spark, docs, nothing):
    rng = random.Random(7)
    vocab = [f"{a}{b}{c}" for a in ("ta", "mo", "ri", "lun") for b in ("ster", "ving", "do") for c in ("n", "ke", "ral")]
    bad = ["wretched", "vermin", "filthy"]
    rows = []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        if toxic := i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("score", F.lit("clash"))
    model = toxicity.fit_toxicity(df, df.filter("doc_id % 2 = 0").select("doc_id", "toxic"))
    held = toxicity.score_toxicity(df.filter("doc_id % 2 = 1"), model).collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    low = toxicity.score_toxicity(docs, model).filter("doc_id in (1, 2, 3)").collect()
    assert all(r.predicted == 0 and 0 <= r.score < 0.5 for r in low)
    nobody = toxicity.fit_toxicity(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score_toxicity(docs, nobody).collect()} == {0}
    assert toxicity.score_toxicity(nothing, model).count() == 0


def test_toxicity_of_rare_words(spark):
    """Toxic words that each few toxic texts have are learned, and only whole words count."""
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in ("ster", "ving", "dohm", "kalt", "brun") for b in ("nach", "ling", "keit", "rund", "mose", "tave")]
    rare = [f"achlich{x}" for x in ("keit", "ung", "ver", "tz", "pf", "en", "sch", "heit", "au", "be", "ge", "ie", "te", "st", "lich", "ber", "ein", "chen", "ter", "ner", "mal", "los", "bar", "sam", "voll")]
    rows = []
    for i in range(3000):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        if toxic := i % 3 == 0:
            for word in rng.sample(rare, 1):
                w.insert(rng.randrange(len(w)), word)
        elif i % 3 == 1:
            w.insert(rng.randrange(len(w)), "achlich" + rng.choice("xyzvwq") + rng.choice("aeiou"))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df, df.filter("doc_id % 2 = 0").select("doc_id", "toxic"))
    held = toxicity.score_toxicity(df.filter("doc_id % 2 = 1"), model).collect()
    assert sum(r.predicted for r in held if r.toxic) >= 0.95 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.02 * len(held)


def test_windows_of_blocks_are_those_of_the_whole(monkeypatch):
    text = " ".join(f"Wort{chr(97 + i % 26)}'s x_{i}\tü{i}" for i in range(400)) + "\u2028" + "y" * 500
    whole = [*toxicity.windows(text)]
    words = " ".join(whole).split()
    assert words[:4] == ["WORTA's", "X", "0", "Ü0"] and len(whole) == -(-len(words) // toxicity.WINDOW)
    monkeypatch.setattr(toxicity, "BLOCK", 37)
    assert [*toxicity.windows(text)] == whole
    assert [*toxicity.windows(None)] == [*toxicity.windows("")] == [*toxicity.windows(" _-. ")] == []


def test_savings_match_a_plain_compressor():
    import zstandard as z

    model = toxicity.Model(b" SOME COMMON WORDs of the PLAIN kind", b" HORRId VERMIn NASTY", (0.0, 0.0, 0.0, 0.0))
    text = "plain horrid words " * 9 + "nasty vermin some common words " * 5
    p = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY2, min_match=6, window_log=16, hash_log=14, chain_log=14, search_log=6, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
    saved = []
    for w in toxicity.windows(text):
        sizes = []
        for middle in (b"\xff" * len(model.toxic), model.toxic):
            d = z.ZstdCompressionDict(model.ordinary + middle + toxicity.LEAD, dict_type=z.DICT_TYPE_RAWCONTENT)
            frame = z.ZstdCompressor(compression_params=p, dict_data=d).compress(toxicity.LEAD + w.encode() + toxicity.TAIL)
            assert z.ZstdDecompressor(dict_data=d).decompress(frame, max_output_size=10_000) == toxicity.LEAD + w.encode() + toxicity.TAIL
            sizes.append(len(frame))
        saved.append(sizes[0] - sizes[1])
    top = sorted((s for s in saved if s > 0), reverse=True)
    assert sum(top) > 0 and toxicity.saved_bytes(text, *model.compressors()) == (sum(top[:3]), sum(top), len(saved))
    assert toxicity.saved_bytes(None, *model.compressors()) == (0, 0, 0)


def test_rest_is_what_telling_substrings_cover():
    rng = random.Random(11)
    for _ in range(300):
        word = f" {''.join(rng.choice('ABab') for _ in range(rng.randrange(1, 12)))} "
        telling = frozenset("".join(rng.choice("ABab ") for _ in range(5)) for _ in range(60))
        on = {k for i in range(len(word) - 4) if word[i : i + 5] in telling for k in range(i, i + 5)}
        assert toxicity.rest(word, telling) == "".join(c for k, c in enumerate(word) if k in on)
    assert toxicity.parts("an idiotic") == {" IDIO", "IDIOT", "DIOTi", "IOTic", "OTic "}


def test_threshold_has_the_best_f1():
    rng = np.random.default_rng(12)
    for _ in range(50):
        z, y = rng.integers(0, 8, 40) / 4.0, (rng.random(40) < 0.4).astype(float)
        y[0] = 1
        f1 = lambda t: 2 * y[z >= t].sum() / ((z >= t).sum() + y.sum())  # noqa: E731, B023
        assert f1(toxicity._threshold(z, y)) == pytest.approx(max(f1(t) for t in z))


# --- brute force -----------------------------------------------------------


def plain_vector(text):
    """Hashed counts of letter pairs and triples, one n-gram at a time."""
    code, mask = [0], (1 << 32) - 1
    for ch in (text or "").lower():
        if ch.isalpha():
            code.append(ord(ch))
        elif code[-1]:
            code.append(0)
    if code[-1]:
        code.append(0)
    place = lambda h: (((h ^ (h >> 15)) & mask) * 0x2C1B3C6D & mask) >> 20
    out = Counter()
    for i in range(len(code) - 1):
        pair = (code[i] * 0x9E3779B1 + code[i + 1] * 0x85EBCA6B) & mask
        if code[i] or code[i + 1]:
            out[place(pair)] += 1
        if i + 2 < len(code) and code[i + 1]:
            out[place((pair + code[i + 2] * 0xC2B2AE35 + 0x165667B1) & mask)] += 1
    return out


def unit(counts, idf):
    v = {k: math.log1p(n) * idf[k] for k, n in counts.items()}
    size = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {k: x / size for k, x in v.items()}


def test_language_by_brute_force(spark, docs):
    rng = random.Random(18)
    syllables = {"aa": ("ba", "do", "ki"), "bb": ("schu", "ter", "oß"), "cc": ("lé", "qui", "ou")}
    rows = [(i, "".join(rng.choice(syllables[la]) + rng.choice(("", " ", ", ")) for _ in range(rng.randrange(20, 60))), la) for i, la in enumerate(rng.choice(sorted(syllables)) for _ in range(90))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_centroids(df, clusters=1)
    counts_ = [plain_vector(t) for _, t, _ in rows]
    held = Counter(k for c in counts_ for k in c)
    idf = defaultdict(lambda: math.log(1 + len(rows)) + 1, {k: math.log((1 + len(rows)) / (1 + n)) + 1 for k, n in held.items()})
    centroids, limits = {}, {}
    for la in syllables:
        own = [unit(c, idf) for c, (_, _, x) in zip(counts_, rows) if x == la]
        total = Counter()
        for v in own:
            total.update(v)
        size = math.sqrt(sum(x * x for x in total.values()))
        centroids[la] = {k: x / size for k, x in total.items()}
        cosines = sorted(sum(x * centroids[la].get(k, 0) for k, x in v.items()) for v in own)
        limits[la] = 0.5 * float(np.quantile(cosines, 0.005))
    texts_ = [t for _, t in texts(docs)] + [t[:15] for _, t, _ in rows[:20]] + ["baba schuter léqui", "zzzz", "1234"]
    for t, (la, cosine, rejected) in zip(texts_, model.predict(texts_)):
        v = unit(plain_vector(t), idf)
        if not v:
            assert (la, cosine, rejected) == ("und", 0.0, True)
            continue
        of = {x: sum(y * centroids[x].get(k, 0) for k, y in v.items()) for x in centroids}
        best = max(of, key=of.get)
        assert cosine == pytest.approx(min(1, of[best]), abs=1e-4)
        if sorted(of.values())[-1] - sorted(of.values())[-2] > 1e-4:
            assert la == best and (rejected == (of[best] < limits[best]) or abs(of[best] - limits[best]) < 1e-4)


def features_of(t):
    """All features of the quality rules, counted plainly."""
    n, chars, symbols, dups, repeats = counts(t)
    joined = "".join(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    lines = len([x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    upper = sum(unicodedata.category(c) == "Lu" for c in joined)
    return {
        "symbol_ratio": symbols / max(chars, 1), "upper_ratio": upper / max(chars, 1), "digit_ratio": len(re.findall("[0-9]", joined)) / max(chars, 1),
        "mean_word": chars / max(n, 1), "repeat_ratio": repeats / max(n, 1), "dup_line_ratio": dups / max(lines, 1), "n_words": float(n),
    }, n < 10 or 100 * repeats > 20 * n


def verdict(t, rules):
    row, failed = features_of(t)
    return 0 if failed else next((i for i, r in enumerate(rules, 1) if r.holds(row)), None)


def test_verdicts_match_rules(spark, docs, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = table.union(docs.select("doc_id", "text"))
    planted = [quality.Rule((quality.Test("n_words", False, 100.0), quality.Test("upper_ratio", True, 0.01))), quality.Rule((quality.Test("mean_word", False, 5.0),)), quality.Rule((quality.Test("digit_ratio", True, 0.001), quality.Test("dup_line_ratio", False, 0.5)))]
    for rules in (planted, quality.fit_rules(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))):
        got = quality.judge_quality(df, rules).select("text", "rule_no", "kept", "base_failed").collect()
        assert len(got) == df.count()
        for r in got:
            assert r.rule_no == verdict(r.text, rules) and r.kept == (r.rule_no is None) and r.base_failed == (r.rule_no == 0)
    assert {r.rule_no for r in quality.judge_quality(df, planted).collect()} >= {None, 0, 1, 2}


def test_media_digests(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in queries.op8_mpeg_audio(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t in texts(docs):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = audio.pack(payload, str(len(raw)))
        x = audio.parse(media)
        starts = [m for m in x["offsets"]]
        seek = zlib.crc32(",".join(map(str, starts)).encode())
        frames = -(-len(payload) // (audio.header(bytes((0xFF, 0xFA, 0xE0, 0))).size - audio.HEAD))
        assert len(starts) == frames and all(media[k : k + 2] == b"\xff\xfa" for k in starts)
        feature = f"mpeg1 layer3 44100Hz 2ch frames={frames}/{frames} samples={1152 * frames} us={1152 * frames * 1_000_000 // 44100} crc={frames + 1}/{frames + 1} skipped=0 seek={seek:08x}"
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature] += 1
    assert got == want


def test_very_long_text(spark, tmp_path):
    """A text of 2.4 million characters goes whole through every operator, beside short ones."""
    from tokenizers import Tokenizer

    rng = random.Random(19)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    long = "\n".join(" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(33_000)) + " the end"
    df = spark.createDataFrame([(1, "a short text of a few words for company here"), (2, long), (3, None)], "doc_id long, text string")
    n = len(long.split())
    row = quality.judge_quality(df, []).filter("doc_id = 2").first()
    assert (row.n_words, row.word_chars, row.n_dup_lines, row.n_repeat_words) == (lambda c: (c[0], c[1], c[3], c[4]))(counts(long))
    assert {r.doc_id: r.n_tokens for r in mixing.score_domains(df, mixing.Classifier(["a", "b"], [0.0, 0.0])).collect()} == {1: 10, 2: n, 3: 0}
    got = {r.doc_id: r for r in bpe.bpe_round_trip(df, P.path("byte_bpe_50k.json")).collect()}
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert got[2].decoded == long and got[2].ids == lib.encode(long, add_special_tokens=False).ids
    files = tokenfile.read_token_files(spark, tokenfile.write_token_files(df, f"file://{tmp_path}/t", P.path("word_bpe_49k.json"))).collect()
    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert {r.doc_id: r.n_tokens for r in files}[2] == len(words.encode(long, add_special_tokens=False).ids) + 1
    media = audio.read_audio(audio.text_to_audio(df)).filter("doc_id = 2").first().info
    assert bytes(media.body[: len(long.encode())]).decode() == long
    assert sharding.assign_shards(df).filter("doc_id = 2").first()["size"] == len(long.encode()) + 1
    scored = {r.doc_id: r for r in toxicity.score_toxicity(df, toxicity.Model(b" SOME TEXT", b" SHORT TEXT", (0.0, 1.0, 0.0, 0.0))).collect()}
    assert scored[2].n_windows == -(-len(toxicity._WORD.findall(long)) // toxicity.WINDOW) and scored[3].score == 0
    found = {r.doc_id: r.class_id for r in jaccard.similar_documents(df.union(spark.createDataFrame([(4, long + " more")], df.schema))).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 2}


def test_clashing_columns(spark, docs):
    """Extra columns with the names of results and of other operators' columns go or stay, as stated, and change nothing."""
    names = ["n_tokens", "posterior", "saved", "best", "n_windows", "predicted", "rejected", "ids", "decoded", "media", "info", "rule_no", "kept", "n_lines", "shard", "slot"]
    more = docs.withColumns({c: F.lit("clash") for c in names})
    plain = docs.select("doc_id", "text")
    same = lambda f, cols: Counter(map(tuple, f(more).select(*cols).collect())) == Counter(map(tuple, f(plain).select(*cols).collect()))
    model = mixing.Classifier(["a", "b"], [0.0, 0.5], {"1:the": [1.0, 0.0]})
    assert same(lambda d: mixing.score_domains(d, model).withColumn("p", F.array_join(F.col("posterior").cast("array<string>"), ",")), ("doc_id", "n_tokens", "p"))
    assert same(lambda d: toxicity.score_toxicity(d, toxicity.Model(b"x", b" IDIOT")), ("doc_id", "saved", "score", "predicted"))
    assert same(lambda d: quality.judge_quality(d, []), ("doc_id", "n_words", "kept", "rule_no", "n_lines"))
    assert same(lambda d: bpe.bpe_round_trip(d, P.path("byte_bpe_50k.json")), ("doc_id", "decoded"))
    assert same(lambda d: audio.read_audio(audio.text_to_audio(d)).select("doc_id", "info.samples"), ("doc_id", "samples"))
    assert same(sharding.assign_shards, ("doc_id", "size", "shard", "grown_shard"))
    assert same(jaccard.similar_documents, ("doc_id", "class_id", "n_links"))
    assert same(lambda d: langid.identify(d, langid.fit_centroids(docs)), ("doc_id", "lang_pred", "rejected"))
