import zlib
from collections import defaultdict

import brute
import pyarrow.parquet as pq
import pytest

from veduta.llm import language, packing, private, tokens

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "x <|endoftext|> y<|endoftext|>"), (4, "x <|endoftext|> y<|endoftext|>"), (5, "日本語 テキスト é ﬁ   \x1c z"), (6, "123456 don't we'll I'M"), (7, "a" * 9000), (8, " " * 9000 + "x")]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def counted(tokenizer, rows):
    out = []
    for i, t in rows:
        n = len(ids(tokenizer, t))
        out.append((i, len((t or "").encode()), n, n > 512))
    return sorted(out, key=str)


def test_token_counts(spark, tokenizer):
    assert sorted((tuple(r) for r in tokens.op9_tokens(spark, SF).collect()), key=str) == counted(tokenizer, texts())


@pytest.mark.parametrize("common,few", [(128, 4), (1, 10**6), (10**9, 0)])
def test_token_counts_odd_rows(spark, tokenizer, common, few):
    docs = brute.documents(spark, ODD, extra=True).repartition(3)
    got = sorted((tuple(r) for r in tokens.token_counts(docs, common=common, few=few).collect()), key=str)
    assert got == counted(tokenizer, ODD)
    assert tokens.token_counts(docs.limit(0)).count() == 0


def check_packing(rows, out, tokenizer, length=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {i for i, _ in rows}
    whole = {i: [*ids(tokenizer, t), 2] for i, t in rows}
    for i, own in pieces.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= length and (k == 0 or r.length == length)
            part = whole[i][at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
        assert at == len(whole[i]) and (len(own) == 1 or at > length)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences), sum(map(len, whole.values())) / length


def test_packing(spark, tokenizer):
    used, least = check_packing(texts(), packing.op3_packing(spark, SF).collect(), tokenizer)
    assert used <= 1.05 * least + 2


def test_packing_odd_rows(spark, tokenizer):
    rows = [r for i, r in enumerate(ODD) if i != 5]
    check_packing(rows, packing.packed(brute.documents(spark, rows, extra=True)).collect(), tokenizer)
    docs = brute.documents(spark, ODD)
    assert packing.packed(docs).count() == packing.packed(docs.dropDuplicates(["doc_id"])).count() + 1
    assert packing.packed(docs.limit(0)).count() == 0
    with_ids = packing.packed(docs, ids=True).first()
    assert len(with_ids.ids) == with_ids.length


def test_bins_close_fullest_first():
    import random

    rng = random.Random(1)
    own, free, closed = packing.BestFit(100, 3), {}, set()
    for _ in range(2000):
        n = rng.randrange(1, 101)
        k, offset = own.put(n)
        assert k not in closed
        if k in free:
            assert free[k] == min(f for f in free.values() if f >= n) and offset == 100 - free[k]
        else:
            assert offset == 0 and not any(f >= n for f in free.values())
        free[k] = free.get(k, 100) - n
        if not free[k]:
            del free[k]
        if len(free) > 3:
            still = {b for own_bins in own.by_free for b in own_bins}
            (gone,) = set(free) - still
            assert free[gone] == min(free.values())
            closed.add(gone)
            del free[gone]


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = language.op1_language(spark, d).collect()
    t = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "lang", "text"])
    lang = dict(zip(t["doc_id"].to_pylist(), t["lang"].to_pylist(), strict=True))
    assert {r.doc_id for r in got} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.93 * len(held)


def test_language_reads_text_alone(spark):
    """Held-out rows with another lang, source or id get the same answer, and teach nothing."""
    base = [(i, f"the house and the garden number {i}", "en", "a") if i % 2 else (i, f"das haus und der garten nummer {i}", "de", "b") for i in range(60)]
    out = [r for r in base if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    turned = [(i, t, "de" if g == "en" else "en", "z") if (i, t, g, s) in out else (i, t, g, s) for i, t, g, s in base]
    answers = []
    for rows in (base, turned):
        docs = brute.documents(spark, rows)
        answers.append(sorted((r.doc_id, r.lang_pred) for r in language.classified(docs.select("doc_id", "text"), language.train(docs)).collect()))
    assert answers[0] == answers[1] and all(g == ("en" if i % 2 else "de") for i, g in answers[0])


def test_language_odd_rows(spark):
    docs = brute.documents(spark, [(*r, None, None) for r in ODD], extra=True)
    nothing = language.train(docs)  # no lang at all
    assert {(r.lang_pred, r.score) for r in language.classified(docs, nothing).collect()} == {("und", 0.0)}
    assert language.language_filter(docs).count() == 0
    rows = [(i, "the quick house", "en", None) for i in range(20)] + [(100 + i, "das schnelle haus", "de", None) for i in range(20)] + [(200, None, "en", None), (201, "12 34", None, None), (None, "the house", None, None)]
    docs = brute.documents(spark, rows, extra=True)
    kept = language.language_filter(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id: (r.lang_pred, r.score) for r in kept.collect()}
    assert 200 not in got and 201 not in got and got[0] == ("own lang_pred", "own score")
    assert language.classified(docs.limit(0), nothing).count() == 0


def test_temperature_calibrates():
    import numpy as np

    rng = np.random.default_rng(1)
    true = rng.normal(size=(4000, 3))
    p = np.exp(true) / np.exp(true).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(language.temperature(true * 5, labels) - 5) < 0.6


KEY = "a key"


def luhn_ok(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def replaced(spark, rows):
    return {r.doc_id: r for r in private.pseudonymised(brute.documents(spark, rows), KEY).collect()}


def test_pseudonyms_keep_format_and_links(spark):
    import datetime
    import re

    card, date, ssn, host, mail, phone = "4111 1111 1111 1111", "1999-12-31", "219-09-9999", "10.20.30.40", "Jane.Doe7@mail.example.com", "+44 20 7946 0958"
    rows = [(1, f"pay {card} on {date}, {ssn} at {host} or {mail} or call {phone}."), (2, f"again: {mail}; {card}; {date}"), (3, "4111 1111 1111 1112 and 1999-13-40 and 999-00-0000"), (4, None), (5, ""), (6, "nothing here 12")]
    got = replaced(spark, rows)
    assert got[4].text is None and [got[i].text for i in (3, 5, 6)] == [rows[2][1], "", rows[5][1]] and got[3].n_private == 0
    m = re.fullmatch(r"pay (\d{4} \d{4} \d{4} \d{4}) on (\d{4}-\d\d-\d\d), (219-\d\d-\d{4}) at ([\d.]+) or (\S+) or call (\+44[\d ]+)\.", got[1].text)
    assert m and luhn_ok(m[1]) and got[1].n_private == 6
    datetime.date.fromisoformat(m[2])
    assert not set(m.groups()) & {card, date, ssn, host, mail, phone}
    assert re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}\d@[a-z]{4}\.[a-z]{7}\.com", m[5]) and re.fullmatch(r"\+44 \d\d \d{4} \d{4}", m[6])
    assert got[2].text == f"again: {m[5]}; {m[1]}; {m[2]}"


def test_pseudonyms_are_a_permutation(spark):
    days = [f"{y}-{m:02}-01" for y in range(1950, 2050) for m in range(1, 13)]
    got = replaced(spark, list(enumerate(days)))
    assert len({r.text for r in got.values()}) == len(days)
    hosts = [f"{a}.{b}.0.1" for a in range(1, 30) for b in range(30)]
    assert len({r.text for r in replaced(spark, list(enumerate(hosts))).values()}) == len(hosts)


def test_pseudonyms_odd_rows(spark):
    docs = brute.documents(spark, [*ODD, (9, "x " * 200_000 + "219-09-9999")], extra=True)
    docs = docs.withColumns({"n_private": docs.doc_id, "__found": docs.doc_id, "__new": docs.doc_id, "a.b": docs.doc_id})
    got = private.pseudonymised(docs, KEY)
    assert got.columns == [*[c for c in docs.columns if c != "n_private"], "n_private"] and got.count() == len(ODD) + 1
    assert got.where("__found <=> doc_id AND __new <=> doc_id AND `a.b` <=> doc_id").count() == len(ODD) + 1
    long = got.where("doc_id = 9").first()
    assert long.n_private == 1 and len(long.text) == 400_011
    assert private.pseudonymised(docs.limit(0), KEY).count() == 0


def test_pseudonyms_need_a_key(spark):
    docs = brute.documents(spark, [(1, "219-09-9999")])
    with pytest.raises(ValueError, match="no key"):
        private.pseudonymised(docs)
    spark.conf.set(private.KEY_SETTING, KEY)
    try:
        assert private.pseudonymised(docs).first().text == replaced(spark, [(1, "219-09-9999")])[1].text
    finally:
        spark.conf.unset(private.KEY_SETTING)
    assert private.pseudonymised(docs, "other").first().text != private.pseudonymised(docs, KEY).first().text


def shape(s):
    import re

    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))


def test_pseudonyms_against_plain_feistel(spark):
    """Secrets, hosts, numbers and tokens as a plain version of the network gives them; one-to-one, in their shape."""
    import random
    import re

    rng = random.Random(4)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    small, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    secrets = list(dict.fromkeys(some(small + small.upper() + "0123456789@@.-_#é", rng.randrange(4, 30)) for _ in range(600)))
    secrets = [x for x in secrets if not re.search(private.EMAIL, x)]
    secrets += ["ab@cdef", "ab@zzzz9", "hello@wor-ld.x1", "aaaa", "aaab", "@@@@", "12@4"]
    rows = [(i, f"password={x} end") for i, x in enumerate(secrets)]
    got = {x: r.text.removeprefix("password=").removesuffix(" end") for x, r in zip(secrets, [v for _, v in sorted(replaced(spark, rows).items())], strict=True)}
    assert len(set(got.values())) == len(got) and all(shape(a) == shape(b) for a, b in got.items())
    assert got == {x: brute.permuted(x, "secret", KEY) for x in secrets}
    tokens = [some(hexa, rng.randrange(32, 65)) for _ in range(100)]
    tokens += [x.upper() for x in tokens if not x.isdigit()]
    got = [r.text[1:-1] for _, r in sorted(replaced(spark, [(i, f"'{x}'") for i, x in enumerate(tokens)]).items())]
    assert got == [brute.hexed(x, KEY) for x in tokens] and len(set(got)) == len(got)
    hosts = [f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(200)]
    got = [r.text for _, r in sorted(replaced(spark, list(enumerate(hosts))).items())]
    value = lambda h: sum(int(x) << s for x, s in zip(h.split("."), (24, 16, 8, 0), strict=True))
    assert [value(x) for x in got] == [brute.feistel(value(h), 65536, 65536, "host", KEY) for h in hosts]
    numbers = [f"{rng.randrange(1, 600):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}" for _ in range(200)]
    got = [r.text for _, r in sorted(replaced(spark, list(enumerate(numbers))).items())]
    assert [x.replace("-", "")[3:] for x in got if x[:3] != "666"] == [f"{brute.feistel(int(n.replace('-', '')[3:]), 1000, 1000, 'ssn ' + n[:3], KEY):06}" for n in numbers if n[:3] != "666"]


def test_pseudonyms_of_further_forms(spark):
    import datetime
    import re

    token = "0123456789ABCDEF" * 2
    rows = [(1, "at 2024-01-15T10:00:00Z"), (2, f'"{token}"'), (3, "4000 0000 0000 0000 006 and 4111 1111 1111 1111 12 apples"), (4, "4111-1111-1111-1111"), (5, "2024-01-15Tea")]
    got = {i: r.text for i, r in replaced(spark, rows).items()}
    assert re.fullmatch(r"at \d{4}-\d\d-\d\dT10:00:00Z", got[1]) and got[1] != rows[0][1]
    datetime.date.fromisoformat(got[1][3:13])
    assert re.fullmatch(r'"[0-9A-F]{32}"', got[2]) and token not in got[2]
    m = re.fullmatch(r"(\d{4} \d{4} \d{4} \d{4} \d{3}) and (\d{4} \d{4} \d{4} \d{4}) 12 apples", got[3])
    assert m and luhn_ok(m[2]) and m[2] != "4111 1111 1111 1111"
    assert luhn_ok(got[4]) and got[4] != rows[3][1] and got[5] == rows[4][1]
