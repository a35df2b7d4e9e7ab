"""What the operators must answer, worked out row by row in plain Python."""

import bisect
import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, extra=False):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:  # names that the operators use themselves
        from pyspark.sql import functions as F

        names = "row rep key keys label labels class_id kept score lang_pred size taken id at bucket chunk length piece text_hash recipe n digest told".split()
        names += [f"__{c}" for c in "id own of hash doc row text told mix_n r0 key k salt found range order".split()] + ["a.b", "A b"]
        df = df.withColumns({c: F.lit(f"own {c}") for c in names})
    return df


def labels(text, k=5):
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return []
    k = min(k, len(words))
    seen, out = Counter(), []
    for i in range(len(words) - k + 1):
        g = tuple(words[i : i + k])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def similarity(a, b):
    """L / (|a| + |b| - L) over labels, each of which occurs once; L is a longest increasing subsequence."""
    if not a or not b:
        return 0.0
    where, tails = {x: i for i, x in enumerate(b)}, []
    for x in a:
        if (p := where.get(x)) is not None:
            k = bisect.bisect_left(tails, p)
            tails[k : k + 1] = [p]
    return len(tails) / (len(a) + len(b) - len(tails))


def near_classes(rows, least=0.8):
    """index of a row -> least index of its class."""
    own = [labels(t) for _, t in rows]
    words = [tuple(re.findall(r"\w+", (t or "").lower())) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if words[i] and (words[i] == words[j] or similarity(own[i], own[j]) >= least):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(rows))]


def repeats(rows, window=50):
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _hash(key, *values):
    """What the SQL function xxhash64 makes of a string, an int, a string and a long."""
    import struct

    import xxhash

    seed = 42
    for v, kind in zip((key, *values), ("s", "<i", "s", "<q"), strict=True):
        data = v.encode() if kind == "s" else struct.pack(kind, v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def feistel(x, m, n, label, key, rounds=8):
    """A permutation of the numbers below m * n."""
    a, b = divmod(x, n)
    for r in range(1, rounds + 1):
        a, b, m, n = b, (a + _hash(key, r, label, b) % m) % m, n, m
    return a * n + b


def _blocks(s, size, alphabet, label, key):
    out = ""
    for i in range(0, len(s), size):
        part, base = s[i : i + size], len(alphabet)
        k, value = len(part), 0
        for c in part:
            value = value * base + alphabet.index(c)
        v = feistel(value, base ** (k // 2), base ** (k - k // 2), f"{label} {k} {i // size}", key)
        digits = ""
        for _ in part:
            v, d = divmod(v, base)
            digits = alphabet[d] + digits
        out += digits
    return out


def permuted(s, label, key):
    """Digits, small and capital letters each permuted among themselves."""
    for alphabet, size in (("0123456789", 16), ("abcdefghijklmnopqrstuvwxyz", 6), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 6)):
        form = re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))
        new = iter(_blocks("".join(c for c in s if c in alphabet), size, alphabet, f"{label} {form}", key))
        s = "".join(next(new) if c in alphabet else c for c in s)
    return s


def hexed(s, key):
    out = _blocks(s.lower(), 12, "0123456789abcdef", "hex", key)
    return out.upper() if s == s.upper() and not s.isdigit() else out


def linked(rows, schemas):
    """(conv_id, turn, part, kind, call_id, name, status, error, order_turn, order_part, order_kind, json) of each event."""
    import json

    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    kinds = {"string": str, "number": (int, float), "boolean": bool, "array": list, "object": dict}

    def wrong(name, arguments):
        if name is None:
            return "no name"
        if name not in schemas:
            return "unknown tool"
        if not isinstance(arguments, dict):
            return "arguments are no object"
        for key, (kind, required) in schemas[name].items():
            if required and key not in arguments:
                return f"missing {key}"
            if key in arguments and (not isinstance(arguments[key], kinds[kind]) or (kind == "number" and isinstance(arguments[key], bool))):
                return f"{key} is no {kind}"
        return "undeclared argument" if set(arguments) - set(schemas[name]) else None

    def read(raw):
        try:
            return json.loads(raw)
        except ValueError:
            return None

    events = []
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        results = re.findall(r"(?s)<tool_result>(.*?)</tool_result>", text)
        alone = role == "tool" and not results
        plain = re.sub(r"(?s)<(tool_call|tool_result)>.*?</\1>", "", text).strip(" ")
        own = "" if alone and isinstance(read(text), dict) else plain
        events.append([conv, turn, 0, "message", None, None, None, dump({"content": own, "role": role}), None, None])
        for kind, raws in (("call", re.findall(r"(?s)<tool_call>(.*?)</tool_call>", text)), ("result", [text] if alone else results)):
            for k, raw in enumerate(raws, 1):
                v = read(raw)
                v = v if isinstance(v, dict) else None
                i = None if v is None else v.get("id")
                if i is None and v is not None and kind == "result":
                    i = v.get("tool_call_id")
                i = None if i is None else i if isinstance(i, str) else dump(i)
                name = v.get("name") if v and kind == "call" else None
                known = {"arguments", "id", "name"} if kind == "call" else {"content", "id" if v and "id" in v else "tool_call_id"}
                out = {} if i is None else {"id": i}
                if v is not None:
                    out |= {f: v[f] for f in ("arguments", "name") if f in v} if kind == "call" else {f: v[f] for f in ("content",) if f in v}
                if v is None or i is None or (kind == "call" and name is None) or set(v) - known:
                    out["raw"] = raw
                error = wrong(name, (v or {}).get("arguments")) if kind == "call" else None
                events.append([conv, turn, k, kind, i, name, error, dump(out), (conv, i) if conv is not None and i is not None else None, None])
    first, answers = {}, Counter()
    for e in events:
        if e[8] and e[3] == "call":
            first[e[8]] = min(first.get(e[8], (e[1], e[2])), (e[1], e[2]))
        if e[8] and e[3] == "result":
            answers[e[8]] += 1
    out = []
    for conv, turn, part, kind, i, name, error, text, link, _ in events:
        at, here = first.get(link), (turn, part)
        status = "message" if kind == "message" else "malformed" if i is None else None
        if status is None and kind == "call":
            status = "duplicate" if link and here != at else "answered" if answers[link] and link else "unanswered"
        elif status is None:
            status = "linked" if at else "orphan"
        early = kind == "result" and at and here < at
        out.append((conv, turn, part, kind, i, name, status, error, *(at if early else here), int(kind == "result"), text))
    return out


def seats(sizes, total):
    """Seats by highest quotients; ties to the smaller item."""
    quotients = sorted((-(v / (2.0 * k + 1.0)), i, k) for i, v in sizes.items() if v > 0 for k in range(total))
    return Counter(i for _, i, _ in quotients[:total])


def targets(sizes, cap=3):
    """Sources' targets: shared by weight, the excess over the cap reshared until none is above."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out
