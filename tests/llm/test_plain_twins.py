"""Sharding against a plain twin of plan and slots; recall of the spans that weak supervision adds, on planted data."""

import random
import struct
import zlib
from collections import defaultdict

import xxhash
from tests.llm.conftest import EDGES

from silvan.llm import pii, sharding


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hash_of(*values):
    """Spark's 64-bit hash: each value's with the one before as its seed; a null changes nothing."""
    h = 42
    for v in values:
        if v is not None:
            raw = struct.pack("<i", v) if isinstance(v, bool) else struct.pack("<q", v) if isinstance(v, int) else v.encode()
            h = xxhash.xxh64_intdigest(raw, h)
    return signed(h)


def plain_shards(rows, n):
    """doc_id, size, shard, slot of each row: the longest group first, each to the least loaded shard by looking at all of them."""
    sizes, total = defaultdict(int), 0
    for _, text in rows:
        size = len((text or "").encode()) + 1
        sizes[hash_of(text, text is None)] += size
        total += size
    big = total // (n * sharding.BIG_PER_SHARD) + 1
    items = defaultdict(int)
    for key, size in sizes.items():
        items[(True, key) if size >= big else (False, key % sharding.CHUNKS)] += size
    loads, home = [0] * n, {}
    for item in sorted(items, key=lambda i: (-items[i], i)):
        shard = loads.index(min(loads))
        loads[shard] += items[item]
        home[item] = shard
    placed = defaultdict(list)
    for doc_id, text in rows:
        key, crc = hash_of(text, text is None), zlib.crc32((text or "").encode())
        shard = home[(True, key)] if (True, key) in home else home[(False, key % sharding.CHUNKS)]
        placed[shard].append((hash_of(doc_id, crc) % 64, (doc_id is not None, doc_id or 0), crc, len((text or "").encode()) + 1))
    return sorted((d[1] if d[0] else None, size, crc, shard, slot) for shard, own in placed.items() for slot, (_, d, crc, size) in enumerate(sorted(own)) if d[0])


def test_shards_and_slots_against_a_plain_twin(docs):
    rng = random.Random(11)
    same = ["same text", "other " * 30, None, "", "tie", "eit"]
    rows = [(i, rng.choice([*same, "x" * rng.randint(0, 900), f"own {i}"])) for i in range(900)] + [r[:2] for r in EDGES if r[0] is not None]
    for n in (3, 16):
        got = sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs(rows), n).collect())
        assert got == plain_shards(rows, n)


def planted(rng):
    """A span that only the wide patterns find, the words before it, and its kind."""
    part = lambda *v: rng.choice(v)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice(pii.KINDS)
    name, host = part("joe", "anna.k", "m_ray", "sales"), part("mailbox", "acme-corp", "uni-graz")
    hit = {
        "email": f"{name} [at] {host} {part('[dot] ', '(dot) ', '. ')}{part('com', 'org', 'de', 'net')}",
        "ip": "[.]".join(str(rng.randint(11, 199)) for _ in range(4)),
        "card": None,
        "phone": f"({rng.randint(201, 989)}) {rng.randint(200, 999)}-{number(4)}",
    }[kind]
    if kind == "card":
        head = "4" + number(14)
        total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(head))
        digits = head + str(-total % 10)
        hit = ".".join(digits[k : k + 4] for k in range(0, 16, 4))
    before = {"email": ("contact", "write to", "mail:"), "ip": ("server", "from host", "ip"), "card": ("card", "visa", "credit card"), "phone": ("call", "phone", "tel.")}[kind]
    return kind, part(*before) + " " if rng.random() < 0.8 else "", hit


def test_added_spans_are_recalled(docs):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows, want, decoys = [], set(), set()
    for doc_id in range(500):
        text = ""
        for _ in range(4):
            text += " ".join(word() for _ in range(rng.randint(5, 15))) + " "
            kind, before, hit = planted(rng)
            text += before
            want.add((doc_id, kind, len(text), len(text) + len(hit)))
            text += hit + " "
            if rng.random() < 0.3:
                text += rng.choice(("version ", "order ", "figure "))
                odd = rng.choice(("9876.5432.1098.7655", "000-000-0000"))
                decoys.add((doc_id, len(text)))
                text += odd + " "
        rows.append((doc_id, text))
    found = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in pii.find_pii(docs(rows)).select("doc_id", "pii").collect() for s in r["pii"]}
    for kind in pii.KINDS:
        mine = {w for w in want if w[1] == kind}
        assert len(found & mine) >= 0.9 * len(mine), (kind, len(found & mine), len(mine))
    wrong = {f for f in found if (f[0], f[2]) in decoys}
    assert len(wrong) <= 0.1 * len(decoys), (len(wrong), len(decoys), list(wrong)[:5])
