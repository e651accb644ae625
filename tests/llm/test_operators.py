"""The operators against plain versions, on small fixtures with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns with clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import decontam, langid, mixing, neardup, quality, secrets, sharding, token_counts, toxicity, warc
from weftline.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "b", 3), (5, "The cat sat. The cat sat.\nThe cat sat.", "en", "b", 1),
    (6, "The cat sat. The cat sat.\nThe cat sat.", "en", None, 1), (6, "The cat sat. The cat sat.\nThe cat sat.", "en", None, 1), (None, "no id here", "fr", "c", 1),
    (7, "wörter  und mehr   zeilen\x00\x1c é🎉" * 40, "de", "c", 1), (8, "lang " * 30_000, "de", "a", 1),
]


def odd(spark):
    """With extra columns whose names are those of results and of inner steps."""
    rows = [(*r, 7, "x", 1.5, "k", 0, "q", True) for r in ODD]
    return spark.createDataFrame(rows, DOCS + ", size long, row string, target double, digest string, bucket int, s string, kept boolean")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1. token counts


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_token_counts_equal_the_library(spark, pieces):
    told = {r.doc_id: r for r in QUERIES["op1_token_counts"](spark, SF).collect()}
    rows = texts(spark).collect()
    assert len(told) == len(rows)
    for r in rows:
        assert told[r.doc_id].n_tokens == len(pieces.encode(r.text)) and told[r.doc_id].n_bytes == len(r.text.encode())
        assert told[r.doc_id].over_limit == (told[r.doc_id].n_tokens > 4096)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abeht ▁\n\r\t.,<s>/0'é中🎉　\x00ſ")), max_size=40))
def test_prefix_counts_equal_the_library(text):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    own = token_counts.counter(tokenizer_path())
    assert own.prefixes(text) == [len(lib.encode(text[:k])) for k in range(len(text) + 1)]
    for budget in (0, 1, 5):
        cut = own.cut(text, budget)
        assert len(lib.encode(cut)) <= budget and text.startswith(cut)


def test_token_counts_odd(spark, pieces):
    got = token_counts.token_counts(odd(spark), tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r[0]), len(pieces.encode(r[1] or ""))) for r in ODD)
    assert token_counts.token_counts(empty(spark), tokenizer_path()).count() == 0
    cut = token_counts.truncate(odd(spark), tokenizer_path(), 3).collect()
    assert all(r.text is None or len(pieces.encode(r.text)) <= 3 for r in cut) and len(cut) == len(ODD)
    assert token_counts.prefix_counts(odd(spark).where("doc_id = 4"), tokenizer_path()).first().counts == [0, 1, 1, 1]


# 2. mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, level = set(), 0.0
    while True:
        free = [s for s in order if s not in capped]
        level = (share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else level
        new = {s for s in free if level * weight[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= new


@pytest.mark.parametrize("rows_per_bucket", [50_000, 7])
def test_mixing_meets_its_targets(spark, rows_per_bucket):
    docs = texts(spark)
    got = mixing.mix(docs, rows_per_bucket=rows_per_bucket).select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "copies").collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = targets(sizes)
    for source, size in sizes.items():
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {size} and all(math.isclose(r.target, want[source]) for r in own)
        assert sum(r.taken for r in own) == math.floor(own[0].target + 1e-9) or abs(sum(r.taken for r in own) - own[0].target) < 1
        assert all(r.taken <= 2 * r["size"] and r.taken == sum(c.words for c in r.copies) for r in own)
        positions = sorted(c.position for r in own for c in r.copies)
        assert all(0 <= p <= 1 for p in positions)
    again = mixing.mix(docs.repartition(5), rows_per_bucket=11).select("row.doc_id", "taken").collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_due_time_inverts_the_integral(spark):
    grid, schedules = (0.0, 0.25, 1.0), ((1.0, 3.0, 0.0), (0.0, 1.0, 1.0))
    from pyspark.sql import functions as F

    rows = spark.range(101).select((F.col("id") / 100).alias("u"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    got = rows.select("u", mixing.due_time(F.col("u"), F.col("a"), grid, schedules).alias("x"), mixing.due_time(F.col("u"), F.col("b"), grid, schedules).alias("y")).collect()
    for k, name in enumerate("xy"):
        t = np.linspace(0, 1, 100_001)
        w = np.interp(t, grid, schedules[k])
        integral = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        integral /= integral[-1]
        for r in got:
            assert abs(np.interp(r[name], t, integral) - r.u) < 1e-4


def test_mixing_odd(spark):
    got = mixing.mix(odd(spark))
    assert got.count() == len(ODD) and sum(r.taken for r in got.collect()) > 0
    assert {r["size"] for r in got.where("row.doc_id in (1, 2, 3)").collect()} == {0}
    assert mixing.training_order(got).columns == odd(spark).columns
    assert mixing.mix(empty(spark)).count() == 0


def test_training_order_holds_what_is_taken(spark):
    mixed = mixing.mix(texts(spark))
    want = sum(r.taken for r in mixed.select("taken").collect())
    got = mixing.training_order(mixed).collect()
    assert sum(len((r.text or "").split()) for r in got) == want
    whole = {r.doc_id: r.text for r in texts(spark).collect()}
    assert all(whole[r.doc_id].startswith(r.text) for r in got) and any(whole[r.doc_id] != r.text for r in got)


def test_query_is_sorted_by_position(spark):
    got = [r.position_1 for r in QUERIES["op2_source_mixing"](spark, SF).collect()]
    assert [p for p in got if p is not None] == sorted(p for p in got if p is not None) and got[0] is not None


# 3. WARC


def test_warc_round_trip(spark):
    html = "<p>" + "x" * 200
    rows = [(1, "http://a/ä\n", html), (2, None, html), (None, "http://c", html), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "\r\n\r\n" + "é🎉" * 50_000), (1, "again", html)]
    pages = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, first long")
    got = warc.round_trip(pages, payloads=True).collect()
    assert len(got) == len(rows)
    for page, url, text in rows:
        data = (text or "").encode()
        r = next(x for x in got if (x.page_id, x.url) == (page, url))
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        revisit = text == html and page != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == data
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_revisits_refer_to_the_response(spark, tmp_path):
    html = "<p>" + "x" * 200
    pages = spark.createDataFrame([(1, "b", html), (1, "a", html), (2, None, html), (None, None, html)], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}/w")
    fields = [f for path in (tmp_path / "w").iterdir() for f, *_ in warc.Reader(path.open("rb"))]
    ids = {f["WARC-Record-ID"]: f for f in fields}
    assert len(ids) == 4
    for f in fields:
        assert (f["WARC-Type"] == "response") == (f.get("X-Page-ID") == "1")
        if f["WARC-Type"] == "revisit":
            first = ids[f["WARC-Refers-To"]]
            assert (first["WARC-Type"], first["WARC-Target-URI"]) == ("response", "a")


def test_warc_reader_takes_members_in_small_pieces_and_finds_damage():
    import io

    payload = b"hello" * 100
    digest = hashlib.sha256(payload).hexdigest()
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = member.compress(warc.record(1, "u", payload, digest, None)) + member.flush()
    assert [x[1] for x in warc.Reader(io.BytesIO(one * 3), chunk=5)] == [payload] * 3
    with pytest.raises(ValueError, match="ends within"):
        list(warc.Reader(io.BytesIO(one + one[:-9])))
    bad = zlib.compressobj(6, zlib.DEFLATED, 31)
    broken = bad.compress(warc.record(1, "u", payload, "0" * 64, None)) + bad.flush()
    with pytest.raises(ValueError, match="payload digest"):
        list(warc.Reader(io.BytesIO(broken)))


# 4. secrets

WORDS = secrets.default_words()


def plain_spans(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), m.end(), "assign")] * (len(m[2]) >= 6)
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "PASSWD", "api_key", "apiKey", ":", "=", " ", '"', "'", "abc", "a1b2c3", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567", "é", "ſecret", "\n", "pwd"]), max_size=25).map("".join))
def test_base_spans(text):
    got, _ = secrets.find(text, WORDS)
    assert [s for s in got if s[2] != "cred"] == plain_spans(text)


def test_secret_columns(spark):
    got = QUERIES["op4_secret_scan"](spark, "/root/testdata/sf0.01").collect()
    rows = {r.doc_id: r.text for r in texts(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        want = plain_spans(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in want) for k in ("assign", "access", "hex"))


def part_cost(part, words):
    """The cheapest way to guess a part as one thing."""
    size = 10 if part[-1].isdigit() else 26 if part[-1].isalpha() else 33
    low = part.lower()
    costs = [math.log10(size)] if len(part) == 1 else []
    if len(part) >= 3:
        case = 0 if part == low else math.log10(2) * (1 if part.istitle() or part.isupper() else sum(c.isupper() for c in part))
        plain = low.translate(str.maketrans("4@301$57", "aaeoisst"))
        costs += [math.log10(words[low] + 1) + case] if low in words else [math.log10(words[plain] + 1) + case + math.log10(4)] if plain in words else []
        ok = lambda f: all(f(a, b) for a, b in zip(low, low[1:]))
        costs += [math.log10(size * len(part))] * ok(lambda a, b: a == b) + [math.log10(188 * len(part))] * ok(lambda a, b: any(abs(row.find(a) - row.find(b)) == 1 and a in row and b in row for row in ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")))
        costs += [math.log10(4 * size * len(part))] * (ok(lambda a, b: ord(b) - ord(a) == 1) or ok(lambda a, b: ord(a) - ord(b) == 1))
    year, month, day = r"(19|20)\d\d", r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
    for form in (f"{year}[-/._]?{month}[-/._]?{day}", f"{day}[-/._]?{month}[-/._]?{year}", f"{month}[-/._]?{day}[-/._]?{year}", year):
        if re.fullmatch(form, part):
            costs.append(math.log10(365 * 120 if len(part) > 4 else 120))
    return min(costs, default=math.inf)


def brute_cost(value, words):
    """All segmentations of a short value."""
    best = math.inf
    for cuts in itertools.product([0, 1], repeat=len(value) - 1):
        ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(value)]
        best = min(best, sum(part_cost(value[a:b], words) for a, b in zip(ends, ends[1:])))
    return best


def plain_cost(value, words):
    """Every part that ends at each place."""
    best = [0.0]
    for end in range(1, len(value) + 1):
        best.append(min(best[begin] + part_cost(value[begin:end], words) for begin in range(end)))
    return best[-1]


@pytest.mark.parametrize("value", ["secret", "aaaa1", "Adminx9", "qwertyz", "abcd", "x7Kq9", "Loveabc", "adminnnn", "secretttt", "ababab", "cbabcd", "p4ssw0rd", "20240131x", "12312024", "aAaA"])
def test_guess_cost_is_the_least(value):
    assert math.isclose(secrets.guess_cost(value, WORDS), brute_cost(value, WORDS))
    assert math.isclose(plain_cost(value, WORDS), brute_cost(value, WORDS))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["admin", "n", "nnn", "t", "secret", "abc", "cba", "qwe", "ewq", "2024", "0131", "-", "X", "7", "1", "12", "@", "love", "Zz", "aaaaaaa", "!"]), min_size=1, max_size=9).map("".join))
def test_guess_cost_of_any_value_is_the_least(value):
    assert math.isclose(secrets.guess_cost(value, WORDS), plain_cost(value, WORDS))


def test_guess_cost_of_long_runs():
    for value in ("a" * 300 + "b" * 200, "qwerty" * 60 + "aaaa" * 40, "abcdefgh" * 30):
        assert math.isclose(secrets.guess_cost(value, WORDS), plain_cost(value, WORDS))
    assert secrets.guess_cost("ab" * 100_000, WORDS) > 0  # in proportion to the length


def test_guess_cost_orders_values():
    cost = lambda x: secrets.guess_cost(x, WORDS)
    assert len(WORDS) > 20_000 and cost("password123") < 7 < 11 < cost("x9Kq2mVt7Lp4")
    assert cost("2024-01-31") < 6 and cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 5 and cost("wintergarden") < 9


CONTEXT_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "pwd", "passphrase", "passcode", "credentials", "credential", "bearer", "private_key", "privatekey", "access_key", "accesskey", "auth_key", "authkey", "client_id", "clientid", "login", "pin")


def context_at(text, i):
    """(value begin, value end) of a credential context that begins at i, read character by character."""
    for word in CONTEXT_WORDS:
        if text[i : i + len(word)].lower() != word or not text[i : i + len(word)].isascii():
            continue
        at = i + len(word)
        places = []
        for j in ([at + 1] if text[at : at + 1] in ('"', "'") else []) + [at]:
            k = j
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] in (":", "=") and text[k : k + 1]:
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                places.append(k)
        if word == "bearer" and text[at : at + 1] == " ":
            places.append(at + 1)
        for k in places:
            quote = text[k : k + 1] if text[k : k + 1] in ('"', "'") else ""
            begin = end = k + len(quote)
            while end < len(text) and "!" <= text[end] <= "~" and (not quote or text[end] != quote):
                end += 1
            if end - begin >= 6:
                if not quote:
                    while end > begin and text[end - 1] in "\"',;.)":
                        end -= 1
                return begin, end
    return None


def plain_cred(text, words, least=10.0):
    base, out, at = plain_spans(text), [], 0
    while at < len(text):
        found = context_at(text, at)
        if found is None:
            at += 1
            continue
        begin, end = found
        full = end
        while full < len(text) and text[full] in "\"',;.)" and text[begin - 1] not in "\"'":
            full += 1
        if end - begin >= 6 and not any(a <= at and end <= b for a, b, *_ in [*base, *out]) and plain_cost(text[begin:end], words) >= least:
            out.append((at, end, "cred"))
        at = max(begin, full - secrets.TAIL)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "pwd", "api_key", "bearer", "pin", ":", "=", " ", '"', "'", "x9!Kq2", "#mVt7", "$Lp4", "abc", ",", "\n", "é", "password"]), max_size=22).map("".join))
def test_added_spans_equal_the_plain_ones(text):
    assert [s for s in secrets.find(text, WORDS)[0] if s[2] == "cred"] == plain_cred(text, WORDS)


def test_added_spans_and_odd_texts(spark):
    text = "pwd: x9!Kq2#mVt7 then token=abcdef"
    assert [s[2] for s in secrets.find(text, WORDS)[0]] == ["cred", "assign"]
    assert secrets.find("pwd: password123", WORDS)[0] == [] and secrets.find(None, WORDS) == ([], 0.0)
    got = secrets.digest_columns(secrets.secret_spans(odd(spark)))
    assert got.count() == len(ODD) and got.where(f"base_sha256 = '{hashlib.sha256(b'').hexdigest()}'").count() == len(ODD)
    assert secrets.secret_spans(empty(spark)).count() == 0
    one = spark.createDataFrame([("a " + text,)], "text string")
    assert secrets.redact(one).first()[0] == "a [secret] then [secret]"


@pytest.mark.parametrize("text, added", [
    ("password: Xk9!vQ#7zL$p2Wm", ["password: Xk9!vQ#7zL$p2Wm"]),
    ('password="$9kQ!x7Lz#Wp"', ['password="$9kQ!x7Lz#Wp']),
    ("secret = aB3$fG7!kL9@qR2", ["secret = aB3$fG7!kL9@qR2"]),
    ("client_secret=A1$kd93!sk", ["secret=A1$kd93!sk"]),
    ("passwd=$kQ!xLz#WpRv", ["passwd=$kQ!xLz#WpRv"]),  # no digit
    ("api_key=abcdefg$kQ9!xLz#Wp4 end", ["api_key=abcdefg$kQ9!xLz#Wp4"]),  # the base span ends at $
    ("token: Bearer x9!Kq2#mVt7", ["Bearer x9!Kq2#mVt7"]),
    ("token=x9Kq2mVt7Lp4", []),  # the base span holds it all
    ('{"token":"abc","next":"/home","secret":"Xk9!vQ#7zL","u":"bob"}', ['secret":"Xk9!vQ#7zL']),
    ("password: $password$123", []),
    ("pwd=ab'cD!9xK#2q rest", ["pwd=ab'cD!9xK#2q"]),
    ("pwd='ab$cD!9xK#2q' rest", ["pwd='ab$cD!9xK#2q"]),
])
def test_base_credential_words_are_contexts(text, added):
    spans, highest = secrets.find(text, WORDS)
    assert [text[a:b] for a, b, k in spans if k == "cred"] == added
    assert [s for s in spans if s[2] != "cred"] == plain_spans(text) and (highest >= 10) >= bool(added)


def test_long_values_are_covered_whole(spark):
    value = "".join(random.Random(4).choices("abcdefghkmXYZ0123456789-_.", k=1000)) + "Z"
    for text in ("Authorization: Bearer " + value, 'passwd="$' + value + '"', "pwd=$" + value):
        spans, highest = secrets.find(text, WORDS)
        assert [(text[a:b][-len(value):], k) for a, b, k in spans] == [(value, "cred")]
        assert highest >= secrets.guess_cost(value, WORDS) > secrets.guess_cost(value[:256], WORDS)
        assert value[-9:] not in secrets.redact(spark.createDataFrame([(text,)], "text string")).first()[0]


# 5. language


def test_language_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, sf).collect()}
    rows = texts(spark, sf).collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_bundle_equals_the_sum_over_occurrences():
    sp = langid.Space(64)
    text = "Der Hund, der bellt"
    keys, counts = langid.counted(sp, [text, None])
    fast = counts @ sp.vectors(keys)
    clean = re.sub(r"[^a-z]+", " ", f" {text.lower()} ")
    slow = np.zeros(64)
    for a, b, c in zip(clean, clean[1:], clean[2:]):
        if b != " ":
            slow += np.roll(langid.letter_vector(ord(a), 64), 2) * np.roll(langid.letter_vector(ord(b), 64), 1) * langid.letter_vector(ord(c), 64)
    assert np.allclose(fast[0], slow) and not fast[1].any()


def test_languages_equal_a_plain_classifier(spark):
    """Bundles by occurrence, prototypes and cosines by hand, for every document."""
    rows, known = texts(spark).collect(), {}

    def vector(gram):
        if gram not in known:
            known[gram] = np.prod([np.roll(langid.letter_vector(ord(c), 1024), 2 - k) for k, c in enumerate(gram)], axis=0).astype(float)
        return known[gram]

    def bundle(text):
        clean = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} "))
        return sum((vector(clean[i : i + 3]) for i in range(len(clean) - 2) if clean[i + 1] != " "), np.zeros(1024))

    own = {r.doc_id: bundle(r.text) for r in rows}
    langs = sorted({r.lang for r in rows if r.lang})
    proto = [sum(own[r.doc_id] for r in rows if r.lang == g and zlib.crc32(str(r.doc_id).encode()) % 4 != 2) for g in langs]
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, SF).collect()}
    for r in rows:
        v = own[r.doc_id]
        cos = [v @ p / (np.linalg.norm(v) * np.linalg.norm(p)) for p in proto]
        assert got[r.doc_id].lang_pred == langs[int(np.argmax(cos))] and abs(got[r.doc_id].score - min(1, max(0, max(cos)))) < 1e-4


def test_language_odd(spark):
    got = {str(r.doc_id): r.lang_pred for r in langid.identify(odd(spark)).collect()}
    assert got["1"] == got["2"] == got["3"] == "und" and got["8"] != "und"
    assert langid.identify(empty(spark)).count() == 0
    untaught = langid.identify(odd(spark).selectExpr(*[c if c != "lang" else "cast(null as string) lang" for c in odd(spark).columns]))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}
    assert langid.keep_identified(odd(spark), least=0.0).columns == odd(spark).columns


SHORT = ["The children walked slowly home from the school.", "It was raining when they left the house.", "Les enfants sont rentrés de l'école avec leurs amis.", "Die Kinder gingen langsam von der Schule nach Hause.", "Los niños volvieron despacio de la escuela a su casa."]
FOREIGN = ["Дети медленно шли домой из школы, когда начался дождь. " * 4, "Τα παιδιά γύρισαν αργά από το σχολείο στο σπίτι τους. " * 4, "孩子们慢慢地从学校走回家，外面开始下雨了。" * 4]


def test_only_what_is_beyond_chance_is_identified(spark):
    rng, foreign = random.Random(5), [*FOREIGN]
    for sizes in ((80,) * 150, (400,) * 50):
        for low, high in ((0x61, 0x7B), (0x3B1, 0x3CA), (0x430, 0x450), (0x4E00, 0x9000)):
            letters = [chr(c) for c in range(low, high)]
            foreign.extend(" ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(n)) for n in sizes)
    docs = texts(spark).select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(SHORT + foreign)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.keep_identified(docs.union(more)).select("doc_id").collect()}
    assert {r.doc_id for r in docs.collect()} <= kept and {-1 - i for i in range(len(SHORT))} <= kept
    assert len([i for i in kept if i < -len(SHORT)]) <= len(foreign) // 200  # at the old cut of 0.05, over a quarter


# 6. decontamination


def plain_hits(text, items):
    w = decontam.words(text)
    hit, found = set(), set()
    for item, other in items:
        o = decontam.words(other)
        k = min(10, len(o))
        wins = {tuple(o[i : i + k]) for i in range(len(o) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found |= {item} - {None}
    return len(w), len(hit), sorted(map(str, found))


def found(block, texts):
    """(text, begin, length, owner) of all occurrences."""
    read, out = decontam.Words(pa.array(texts, pa.string())), set()
    for t in block.tables:
        begin, owner = t.search(read)
        rows = np.searchsorted(read.starts, begin, "right") - 1
        out |= set(zip(rows.tolist(), (begin - read.starts[rows]).tolist(), [t.length] * len(rows), owner.tolist()))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aBz9 -\n_é中🎉\x00")), max_size=60), max_size=5))
def test_words_of_a_lot(texts):
    read = decontam.Words(pa.array([*texts, None, "x" * 100], pa.string()))
    want = [decontam.words(t) for t in [*texts, None, "x" * 100]]
    assert [[read.run(i, 1)[0] for i in range(a, b)] for a, b in zip(read.starts[:-1], read.starts[1:])] == want
    flat = [w for x in want for w in x]
    assert len(set(read.hash.tolist())) == len(set(flat)) == len(set(zip(read.hash.tolist(), flat)))


def test_equal_hashes_are_told_apart():
    block = decontam.Block([(1, "one two three")])
    other = decontam.Words(pa.array(["one two four", "one two three"], pa.string()))
    other.hash[2] = other.hash[5]
    assert block.tables[0].search(other)[0].tolist() == [3]


def plain_found(items, texts):
    out = set()
    for r, text in enumerate(texts):
        w = decontam.words(text)
        for i, item in enumerate(items):
            o = decontam.words(item)
            k = min(10, len(o))
            wins = {tuple(o[j : j + k]) for j in range(len(o) - k + 1)} if k else set()
            out |= {(r, j, k, i) for j in range(len(w) - k + 1 if k else 0) if tuple(w[j : j + k]) in wins}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=60), max_size=4), st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=14), max_size=5))
def test_wu_manber_finds_all(texts, items):
    texts, items = [" ".join(t) for t in texts], [" ".join(i) for i in items]
    assert found(decontam.Block(enumerate(items)), texts) == plain_found(items, texts)


def test_wu_manber_in_long_texts():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(200)]
    items = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 9, 10, 30, 80]))) for _ in range(60)]
    texts = []
    for n in (5, 600, 20_000):
        w = rng.choices(vocab, k=n)
        for item in rng.sample(items, 20):
            at = rng.randrange(len(w))
            w[at:at] = item.split()
        texts.append(" ".join(w))
    assert found(decontam.Block(enumerate(items)), texts) == plain_found(items, texts)


def test_a_compiled_benchmark_is_small():
    import pickle

    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(30_000)]
    items = [" ".join(rng.choices(vocab, k=100)) for _ in range(3000)]
    assert len(pickle.dumps(decontam.Block(enumerate(items)))) < 10 * sum(map(len, items))


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_contamination(spark, block_bytes):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (20, "Short Item!"), (3, None), (4, "..."), (None, "zeta"), (20, "other words"), (100, "short item")]
    docs = [(1, "x one, two THREE four five six seven eight nine ten eleven y short-item"), (2, None), (3, "zeta short\nitem short item"), (4, "one two three four five six seven eight nine"), (4, "other words")]
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id long")
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.items_sha256, r.contaminated) for r in got) == sorted((d, *(p := plain_hits(t, items)), hashlib.sha256(",".join(p[2]).encode()).hexdigest(), p[1] > 0) for d, t in docs)
    kept = decontam.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(((d, t) for d, t in docs if not plain_hits(t, items)[1]), key=str)
    nothing = decontam.contamination(odd(spark), bench.where("false")).collect()
    assert len(nothing) == len(ODD) and not any(r.contaminated for r in nothing)


# 7. sharding


def plain_leaf(key, nodes):
    """Descend the tree by hand: at each level the child whose draw, by the weight below it, is least."""
    def draw(path, weight):
        return -math.log((int(hashlib.md5(f"{key}:{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight

    below = lambda rack: sum(w for _, _, w in rack)
    region = min((r for r in range(len(nodes)) if any(nodes[r])), key=lambda r: draw(str(r), sum(map(below, nodes[r]))))
    rack = min((k for k in range(len(nodes[region])) if nodes[region][k]), key=lambda k: draw(f"{region}/{k}", below(nodes[region][k])))
    return min(nodes[region][rack], key=lambda leaf: draw(leaf[1], leaf[2]))[0]


def flat_leaf(key, nodes):
    """The least draw over all leaves at once, which is not what a descent finds."""
    leaves = [x for region in nodes for rack in region for x in rack]
    return min(leaves, key=lambda x: -math.log((int(hashlib.md5(f"{key}:{x[1]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / x[2])[0]


@pytest.mark.parametrize("rows_per_bucket", [50_000, 2])
def test_sharding(spark, rows_per_bucket):
    docs = texts(spark).unionByName(odd(spark).select(*texts(spark).columns))
    got = sharding.assign(docs, rows_per_bucket=rows_per_bucket).select("row.doc_id", "row.text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert len(got) == docs.count()
    one, more = sharding.tree(24), sharding.tree(25, base=24)
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert r.shard == plain_leaf(key, one) and r.grown_shard == plain_leaf(key, more) and r.grown_shard in (r.shard, 24)
    assert sum(r.shard == flat_leaf(r.doc_id, one) for r in got) < 0.5 * len(got)  # a flat minimum would agree throughout
    for shard in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    assert sharding.assign(empty(spark)).count() == 0


def test_a_changed_weight_moves_rows_only_in_and_out_of_its_subtree(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "'x' text")
    place = lambda w: {r[0]: r[1] for r in sharding.assign(docs, 12, weights=w).select("row.doc_id", "shard").collect()}
    old, new = place({}), place({5: 3.0})
    leaf = {k: path.split("/") for region in sharding.tree(12) for rack in region for k, path, _ in rack}
    moved = [(leaf[old[k]], leaf[new[k]]) for k in old if old[k] != new[k]]
    region, rack = leaf[5][:2]
    assert moved
    for a, b in moved:
        assert b[0] == region  # region: the only one whose weight has grown
        assert a[0] != region or b[1] == rack  # within it, into the rack
        assert a[:2] != [region, rack] or b[2] == "5"  # within the rack, into the shard
    share = sum(v == 5 for v in new.values()) / 3000
    assert abs(share - 3 / 14) < 0.03


# 8. toxicity


def test_toxicity_on_rows_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learn, held = labels.where("doc_id % 3 > 0"), {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in toxicity.classify(texts(spark, sf), learn).collect()}
    assert len(got) == 1000 and all(0 <= r.p_toxic <= 1 for r in got.values())
    assert sum(got[d].toxic and not t for d, t in held.items()) <= 2
    assert sum(got[d].toxic and t for d, t in held.items()) >= 0.6 * sum(held.values())


def test_toxicity_chain_order_and_odd_rows(spark):
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None), (5, 0, 1), (5, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(odd(spark), labels).count() == len(ODD)
    none = toxicity.classify(odd(spark), labels.where("false")).collect()
    assert len(none) == len(ODD) and not any(r.toxic for r in none)
    assert toxicity.classify(empty(spark), labels).count() == 0
    words = [f"w{i}" for i in range(30)]
    rng = random.Random(1)
    bad = [rng.random() < 0.4 for _ in range(300)]
    data = [" ".join(rng.choices(words, k=20)) + " nasty" * b for b in bad]
    models, cut = toxicity.fit_chain(list(range(300)), data, np.array([[b, b] for b in bad], int))
    assert [len(m.d) for m in models] == [1, 2]  # the second model also has the first's log-odds
    rows, feats = toxicity.design(["w1 nasty", "w1 w2"])
    first = models[0].logit(rows, feats, np.empty((2, 0)))
    p = toxicity.sigmoid(models[1].logit(rows, feats, toxicity.squash(first)[:, None]))
    assert p[0] >= cut > p[1]


def plain_features(text):
    words = "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in text or "").split()
    return set(words) | {"^" + w[:4] for w in words}


def plain_fit(sets, dense, y):
    """Logistic regression by hand: a matrix with a column for each feature that is associated with the category."""
    n, pos, chosen = len(y), sum(y), []
    for f in sorted(set().union(*sets)):
        a = sum(t for s, t in zip(sets, y) if f in s)
        df = sum(f in s for s in sets)
        c, top = pos - a, df - a
        if n * (a * (n - pos - top) - c * top) ** 2 / max(pos * (n - pos) * df * max(n - df, 0.5), 1e-9) >= 20:
            chosen.append(f)
    x = np.array([[f in s for f in chosen] for s in sets], float).reshape(n, len(chosen))
    d = np.hstack([np.array(dense, float).reshape(n, -1), np.ones((n, 1))])
    w, v = np.zeros(len(chosen)), np.zeros(d.shape[1])
    rate = min(max(pos / n, 1e-3), 1 - 1e-3)
    v[-1] = math.log(rate / (1 - rate))
    gw, gv = np.full(len(w), 1e-8), np.full(len(v), 1e-8)
    for _ in range(150):
        error = (1 / (1 + np.exp(-np.clip(x @ w + d @ v, -30, 30))) - y) / n
        g, h = x.T @ error + 1e-3 / n * w, d.T @ error
        gw, gv = gw + g * g, gv + h * h
        w, v = w - 0.5 / np.sqrt(gw) * g, v - 0.5 / np.sqrt(gv) * h
    told = dict(zip(chosen, w))
    return lambda s, more: float(np.dot([*more, 1.0], v) + sum(told.get(f, 0.0) for f in s))


def plain_chain(ids, data, labels, new):
    """Probabilities of each category for the new texts, and the verdicts."""
    sets, fresh = [plain_features(t) for t in data], [plain_features(t) for t in new]
    fold = [zlib.crc32(str(i).encode()) % 5 for i in ids]
    dense, now, out = [[] for _ in data], [[] for _ in new], []
    for c in range(labels.shape[1]):
        y, oof = labels[:, c].astype(float), [0.0] * len(data)
        for k in range(5):
            use = [i for i in range(len(data)) if fold[i] != k]
            model = plain_fit([sets[i] for i in use], [dense[i] for i in use], y[use]) if len(use) < len(data) else None
            for i in range(len(data)):
                if fold[i] == k:
                    oof[i] = model(sets[i], dense[i])
        model = plain_fit(sets, dense, y)
        logits = [model(s, m) for s, m in zip(fresh, now)]
        out.append([1 / (1 + math.exp(-x)) for x in logits])
        squash = lambda x: min(8, max(-8, x)) / 4
        dense = [m + [squash(x)] for m, x in zip(dense, oof)]
        now = [m + [squash(x)] for m, x in zip(now, logits)]
    p = sorted(((1 / (1 + math.exp(-x)), t) for x, t in zip(oof, labels[:, -1])), key=lambda r: -r[0])
    f1 = [2 * sum(t for _, t in p[: k + 1]) / (k + 1 + labels[:, -1].sum()) for k in range(len(p))]
    best = f1.index(max(f1))
    cut = (p[best][0] + p[best + 1][0]) / 2
    return out, [x >= cut for x in out[-1]]


def test_toxicity_equals_a_plain_chain(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(160):
        low, bad = rng.random() < 0.3, rng.random() < 0.35
        rows.append((i // 2 if i < 20 else i, " ".join(rng.choices(words, k=12) + ["Sloppy!"] * (low and rng.random() < 0.9) + ["nasty."] * (bad and rng.random() < 0.85)), int(not low), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "nasty sloppy w1"), (902, "")], "doc_id long, text string")
    labels = spark.createDataFrame(sorted({(r[0], r[2], r[3]) for r in rows}), "doc_id long, quality int, toxic int")
    learned = sorted({(r[0], r[1], 1 - q, t & q, t) for r in rows for d, q, t in {(x[0], x[2], x[3]) for x in rows} if d == r[0]}, key=lambda r: (str(r[0]), r[1], r[2:]))
    new = [r[1] for r in rows] + [None, "nasty sloppy w1", ""]
    want, verdict = plain_chain([r[0] for r in learned], [r[1] for r in learned], np.array([r[2:] for r in learned]), new)
    got = {}
    for r in toxicity.classify(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, d in enumerate([r[0] for r in rows] + [900, 901, 902]):
        assert any(all(abs(r[c] - want[k][i]) < 1e-5 for k, c in enumerate(("p_low_quality", "p_toxic_clean", "p_toxic"))) and r.toxic == verdict[i] for r in got[d]), d
    assert sum(verdict) > 20 and not all(verdict)


def test_training_samples_are_bounded(spark):
    from weftline.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i} " + "x" * 100) for i in range(200)] + [(2, "y" * 5000), (3, "z"), (3, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, True), (2, False), (3, True)], "id long, bad boolean")
    take = lambda rows, size: labelled_sample(docs, labels, id_col="doc_id", text_col="text", most_rows=rows, most_bytes=size, seed="s").collect()
    assert len(take(10, 1 << 20)) == 10 and sum(len(r.text) for r in take(500, 2000)) <= 2000 and len(take(500, 1 << 20)) == 202
    assert sorted(map(str, take(10, 1 << 20))) == sorted(map(str, take(10, 1 << 20)))


# 9. near duplicates


def plain_components(docs, percent=75):
    ids = [d for d, _ in docs]
    sets = [neardup.shingles(t) for _, t in docs]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(zip(ids, sets), 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {d: root(d) for d in ids}


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 8, 40, 200]))] for _ in range(30)]
    docs = []
    for words in base:
        for _ in range(rng.randrange(1, 9)):
            new = [w if rng.random() > rng.choice([0, 0.02, 0.06, 0.1]) else "edit" + str(rng.randrange(50)) for w in words]
            docs.append(" ".join(new).upper() if rng.random() < 0.2 else "  ".join(new))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(docs)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "long " * 30_000), (None, docs[0]), (3000, docs[1]), (3000, docs[1]), (3000, docs[60])]
    want = plain_components([r for r in rows if r[0] is not None])
    for block in (256, 2):
        got = neardup.link(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, label long"), block=block).collect()
        assert len(got) == len(rows)
        sizes = sorted((str(d), len(neardup.shingles(t))) for d, t in rows)
        assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sizes
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_any_type_and_keys_that_collide(spark, monkeypatch):
    rows = [("b", "one two three four"), ("a", "One  two three four"), ("c", "other words here now"), ("d", "other words here now then"), ("e", "nothing like it at all"), ("e", "one two three four"), (None, "one two three four")]
    docs = spark.createDataFrame(rows, "name string, body string")
    want = {"a": "a", "b": "a", "c": "c", "d": "c", "e": "a", None: None}
    got = lambda: {r.doc_id: r.component_id for r in neardup.link(docs, id_col="name", text_col="body").collect()}
    assert got() == want
    real = neardup.sketch
    monkeypatch.setattr(neardup, "sketch", lambda *a, **k: real(*a, **k).selectExpr("doc_id", "digest", "n_shingles", "binary('same') set_key", "registers"))
    assert got() == want  # classes whose sets differ are refuted on the texts, and searched anew


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "w"), (1, "far from the rest", "v"), (2, "A b c  d", "u"), (None, "a b c d", "t"), (None, "only without id", "s"), (None, "only without id", "r"), (3, None, "q"), (3, None, "q"), (4, "far from the rest", "p")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, __dropped string, digest int")
    got = neardup.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text), r["__dropped"]) for r in got.collect()) == sorted([("1", "a b c d", "w"), ("1", "far from the rest", "v"), ("None", "only without id", "r"), ("3", "None", "q"), ("3", "None", "q")])
    assert neardup.keep_first(docs.where("false")).count() == 0


def test_setsketch_merges_and_estimates():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, (2, 300)).astype(np.uint64)
    both = np.concatenate([a, b])
    regs = neardup.registers(np.concatenate([a, b, both]), np.array([0, 300, 600, 1200]), 240)
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    j, error = neardup.estimate(regs[:1], regs[2:], np.array([300.0]), np.array([600.0]))
    assert abs(j[0] - 0.5) < 5 * error[0] < 0.3


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# 10. quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = {}
    for i in range(len(words) - 4):
        wins.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for at in wins.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_counts(spark):
    for docs in (texts(spark), odd(spark)):
        want = sorted((str(r.doc_id), *plain_counts(r.text)) for r in docs.collect())
        assert sorted((str(r.doc_id), *(r[c] for c in NAMES)) for r in quality.statistics(docs).collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n\t#é\x0b\x1c\x85")), max_size=80), max_size=4))
def test_repeated_windows(data):
    from weftline.llm.common import split_words

    codes, starts, vocab = split_words(pa.array(data, pa.string()))
    assert quality.repeats(codes, starts, len(vocab)).tolist() == [plain_counts(t)[4] for t in data]
    assert np.diff(starts).tolist() == [plain_counts(t)[0] for t in data]


def test_quality_verdicts_on_rows_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in quality.judge(texts(spark, sf), labels.where("doc_id % 3 > 0")).collect()}
    assert all(not r.kept for r in got.values() if r.base_failed)
    assert sum(not got[d].kept and q == 1 for d, q in held.items()) <= 0.03 * len(held)
    assert sum(not got[d].kept for d, q in held.items() if q == 0) >= 0.7 * sum(q == 0 for q in held.values())


def test_decision_lists():
    rng = np.random.default_rng(0)
    x = rng.random((600, 8))
    y = (x[:, 2] > 0.8) | ((x[:, 6] > 0.5) & (x[:, 7] <= 0.2))
    third = np.arange(600) % 3 == 2
    rules = quality.learn(x, y, third)
    told = np.zeros(600, bool)
    for r in rules:
        told |= quality.covers(r, x)
    assert (told & ~y).sum() <= 6 and (told & y).sum() >= 0.9 * y.sum() and len(rules) <= 6
    assert quality.learn(x, np.zeros(600, bool), third) == []


def plain_list(x, y, third):
    """Sequential covering by hand: rules as lists of (feature, above, threshold)."""
    holds = lambda t, r: r[t[0]] > t[2] if t[1] else r[t[0]] <= t[2]
    left, rules = list(range(len(y))), []
    while len(rules) < 12 and any(y[i] and not third[i] for i in left):
        inside, rule = [i for i in left if not third[i]], []
        while len(rule) < 3 and inside and not all(y[i] for i in inside):
            p0, best, gain = sum(y[i] for i in inside), None, 1e-9
            for f in range(len(x[0])):
                values = sorted({x[i][f] for i in inside})
                marks = [(a + b) / 2 for a, b in zip(values, values[1:])]
                if len(marks) > 64:
                    marks = sorted(set(np.quantile([x[i][f] for i in inside if y[i]], np.linspace(0, 1, 64)).tolist()))
                for t in marks:
                    for above in (True, False):
                        c = [i for i in inside if holds((f, above, t), x[i])]
                        p = sum(y[i] for i in c)
                        if p and p * (math.log2(p / len(c)) - math.log2(p0 / len(inside))) > gain:
                            best, gain = (f, above, t), p * (math.log2(p / len(c)) - math.log2(p0 / len(inside)))
            if best is None:
                break
            f, above, _ = best
            bad = [x[i][f] for i in inside if y[i] and holds(best, x[i])]
            out = [x[i][f] for i in inside if not holds(best, x[i])]
            if bad and out:
                best = (f, above, (min(bad) + max(out)) / 2 if above else (max(bad) + min(out)) / 2)
            rule.append(best)
            inside = [i for i in inside if holds(best, x[i])]
        check = [i for i in left if third[i]]

        def worth(r):
            c = [i for i in check if all(holds(t, x[i]) for t in r)]
            return (2 * sum(y[i] for i in c) - len(c)) / max(1, len(c)) if c else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])
        c = [i for i in left if all(holds(t, x[i]) for t in rule)]
        if not rule or sum(y[i] for i in c) < 3 or sum(y[i] for i in c) / len(c) < 0.97:
            break
        rules.append(rule)
        left = [i for i in left if i not in set(c)]
    return rules


def plain_numbers(text):
    text = text or ""
    n, chars, symbols, dup, again = plain_counts(text)
    lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    per = lambda a, b: a / b if b else 0.0
    return [float(n), per(chars, n), per(symbols, n), per(dup, lines), per(again, n), per(n, lines), per(sum("A" <= c <= "Z" for c in text), chars), per(text.count("!") + text.count("?"), n)]


def test_quality_equals_a_plain_list(spark):
    sf = "/root/testdata/sf0.01"
    docs = texts(spark, sf).where("doc_id % 3 = 0").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id % 3 = 0")
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = sorted((r.doc_id, r.quality == 0, *plain_numbers(rows[r.doc_id])) for r in labels.collect() if r.quality is not None and r.doc_id in rows)
    x, y = [list(r[2:]) for r in known], [r[1] for r in known]
    rules = plain_list(x, y, [zlib.crc32(str(r[0]).encode()) % 3 == 2 for r in known])
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert rules and len(got) == len(rows)
    for d, text in rows.items():
        v, c = plain_numbers(text), plain_counts(text)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        rejected = any(all(v[f] > t if above else v[f] <= t for f, above, t in rule) for rule in rules)
        assert (got[d].base_failed, got[d].kept) == (failed, not failed and not rejected)


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, None), (2, 0), (5, 1), (None, 0), (77, 0)], "doc_id long, quality int")
    for few in (labels, labels.where("false")):
        got = quality.judge(odd(spark), few).collect()
        assert len(got) == len(ODD) and not any(r.kept for r in got if r.n_words < 10)
    assert quality.judge(empty(spark), labels).count() == 0
