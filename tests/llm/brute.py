"""Plain Python versions of the operators, and the rows that tests share."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

SP = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return SP.findall(t or "")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def documents():
    """Rows with nulls, empty and long texts, copies, controls, secrets and repeats."""
    r = random.Random(5)
    voc = ["".join(r.choice(["th", "en", "schö", "ción", "tion", "ba", "re", "né"]) for _ in range(r.randint(1, 4))) for _ in range(900)]
    line = lambda n: " ".join(r.choice(voc) for _ in range(n))
    texts = [None, "", " \t\n", "a", "a b", "x" * 40_000, "ab " * 3000, "日本語テキスト😀 " * 20, "a\n\n\nb\r\n\x0bc", "1 2 3 4"]
    passage = "\n".join(line(12) for _ in range(8))
    base = [line(r.randint(1, 9)) + "\n" + "\n".join(line(r.randint(3, 14)) for _ in range(r.randint(1, 15))) for _ in range(40)]
    texts += base + base[:5] + [b.replace("th", "Th", 1) for b in base[:9]] + [b[: len(b) // 2] + "\n" + passage + "\n" + b[len(b) // 2 :] for b in base[5:12]]
    texts += ["### $$$ %% | < > & " * 9 + line(60), (line(3) + " ") * 30, "a b c a b c " + line(50), (line(5) + "\n") * 12 + line(60)]
    texts += [f"{line(8)} password={'ab1' * 4} {line(3)} AKIA{'QX7Z' * 4} é token=token: abcdef Secret : \"a.b+c/d=\" user=joe {'aB3d' * 10} https://h.example:8080/p?q=1 {'deadbeef' * 4}", "key aB3d" + "Ef9" * 14 + " alone", "AKIAAKIA" + "Z" * 13 + " ap_key api-key:123456 apikey=1234567 APIKEY='zz' hex " + "0f" * 12]
    return [(i if i != 7 else 7, t, ["en", "de", None][i % 3], "s", 0) for i, t in enumerate(texts)] + [(None, base[1], None, None, None), (12, texts[12], "en", "s", 0)]


def quality(t):
    w, t = words(t), t or ""
    lines = [x for x in t.split("\n") if SP.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(w)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return (n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed)


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(t):
    t = t or ""
    a = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    b = [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return len(a), len(b), len(c), sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(a + b + c)))


WEAK = {
    "user": re.compile(r"""(?:[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""),
    "key": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}(?![A-Za-z0-9+/_=-])"),
    "endpoint": re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?[A-Za-z0-9/_.?=&%-]*"),
}


def all_spans(t, scope=400):
    """Every span that a secret scan reports: (start, order of kind, end, kind)."""
    t = t or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    for o, (kind, p) in enumerate(WEAK.items(), 3):
        found += [(m.start(), o, m.end(), kind) for m in p.finditer(t) if kind != "key" or all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
    found = [c for c in found if c[3] != "key" or not any(x[3] != "key" and x[0] <= c[0] and c[2] <= x[2] for x in found)]

    def beside(c, kinds):
        return any(x[3] in kinds and (0 <= c[0] - x[2] <= scope or 0 <= x[0] - c[2] <= scope) for x in found)

    needs = {"user": [("assign", "hex", "key")], "key": [("access", "user")], "endpoint": [("access", "user"), ("assign", "hex", "key")]}
    return sorted(c for c in found if all(beside(c, k) for k in needs.get(c[3], [])))


def shingle_hashes(t):
    w = low(t).encode().split()
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    return [xxhash.xxh64_intdigest(x, 42) for x in g]


def simhash(t):
    h = shingle_hashes(t)
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """{(doc_id, text): component} for fingerprints within 3 bits."""
    fps = [simhash(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(f"{fps[i]:016x}", least.get(find(i))) for i in range(len(rows))]


W8 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(t, items):
    w, hit, found = W8.findall(low(t)), set(), set()
    for item, text in items:
        v = W8.findall(low(text))
        n = min(10, len(v))
        for g in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == g:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


def repeats(rows, k=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    first = {}
    data = {d: (t or "").encode() for d, t in rows}
    for d in sorted(data):
        for i in range(len(data[d]) - k + 1):
            first.setdefault(data[d][i : i + k], d)
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if first[b[i : i + k]] < d:
                gone[i : i + k] = b"\1" * k
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def grouped(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
