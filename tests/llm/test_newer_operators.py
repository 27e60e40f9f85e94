"""Conversation repair, importance resampling and WARC archives against plain versions, with the edge cases their docstrings define."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from functools import reduce

import duckdb
import pytest
from pyspark.sql import functions as F

from tideway.llm import conversations, importance, queries, secrets, warc
from tideway.llm.common import collapsed, read

TURNS = "conv_id long, turn long, role string, text string, header string, copies int, hash string"
PAGES = "page_id long, url string, html string, key string, mark long, chunk int"
DOCS = "doc_id long, text string, n_words long, _scored string"


def sql_rows(sf, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    return [c[0] for c in got.description], Counter(got.fetchall())


@pytest.mark.parametrize("name, tables", [("op11_conversation_repair", ["conversations"]), ("op12_importance_resampling", ["documents", "benchmark"]), ("op13_warc", ["pages"])])
def test_equal_to_sql(spark, sf, name, tables):
    columns, want = sql_rows(sf, name, tables)
    assert Counter(tuple(r[c] for c in columns) for r in queries.queries()[name](spark, sf).collect()) == want


# conversations


def brute(turns):
    """Least (cost, audit) over all edits with at most two inserts at a place; turns are (initial, gone, truncated)."""
    found = []
    gaps = ["", "I", "II"]
    for edits in itertools.product(*(("D",) if gone else ("D", "K", "R") for _, gone, _ in turns)):
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            audit = "".join(g + e for g, e in zip(inserts, [*edits, ""], strict=True))
            costs = [{"K": 0, "R": 2, "D": 3}[e] + (t and e != "D") for e, (_, _, t) in zip(edits, turns, strict=True)]
            at, roles = iter(zip(edits, turns, strict=True)), [""]
            for a in audit:  # every insert or new role may be either
                e, t = ("I", None) if a == "I" else next(at)
                new = {"D": [""], "K": t and [t[0]], "R": ["u", "a"], "I": ["u", "a"]}[e]
                roles = [r + n for r in roles for n in new]
            if any(re.fullmatch("(s?(ua)+)?", r) for r in roles):
                found.append((sum(costs) + 2 * audit.count("I"), audit))
    return min(found)


def kind(initial, gone, truncated):
    return conversations.GONE if gone else "suax".index(initial) + 4 * truncated


def test_least_edits_equal_all_edits():
    rng = random.Random(3)
    for n in (0, 1, 1, 1, *[2] * 12, *[3] * 12, *[4] * 3):
        turns = [(rng.choice("suuaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        cost, audit = conversations.solved(bytes(kind(*t) for t in turns))
        assert (cost, audit.decode()) == brute(turns), turns


def test_products_may_be_taken_in_any_grouping():
    rng = random.Random(4)
    for _ in range(40):
        kinds = bytes(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(2, 40)))
        one = reduce(conversations.times, [conversations.TURNS[k] for k in kinds])
        cuts = sorted(rng.sample(range(1, len(kinds)), min(3, len(kinds) - 1)))
        parts = [conversations.product(kinds[a:b]) for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True)]
        right = reduce(lambda y, x: conversations.times(x, y), parts[::-1])
        assert one == conversations.product(kinds) == conversations.tree(parts) == right
        assert conversations.restored(*conversations.stored(one)) == one


def plain_repair(rows):
    """One conversation's digest, turn by turn; rows are (turn, role, text) before damage, of one conv_id."""

    def digest(conv_id, rows):
        out = []
        for turn, role, text in rows:
            role, text = (" " if x is None else x for x in (role, text))
            code = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, kinds, faults = set(), [], Counter()
        for _, role, text in out:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            kinds.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        best = {"": (0, "", ())}  # last initial -> cost, audit, messages
        step = {"": "u", "s": "u", "u": "a", "a": "u"}
        said = {"u": "user", "a": "assistant"}

        def with_inserts(states):
            states = dict(states)
            for _ in range(2):
                for s, (c, a, m) in list(states.items()):
                    new = (c + 2, a + "I", (*m, f"{said[step[s]]}:"))
                    states[step[s]] = min(states.get(step[s], new), new)
            return states

        for (initial, gone, cut), (_, role, text) in zip(kinds, out, strict=True):
            states, best = with_inserts(best), {}
            for s, (c, a, m) in states.items():
                ways = [(s, (c + 3, a + "D", m))]
                if not gone:
                    ways.append((step[s], (c + 2 + cut, a + "R", (*m, f"{said[step[s]]}:{text}"))))
                    if initial == step[s] or (initial == "s" and s == ""):
                        ways.append((initial, (c + cut, a + "K", (*m, f"{role}:{text}"))))
                for to, way in ways:
                    best[to] = min(best.get(to, way), way)
        states = with_inserts(best)
        cost, audit, messages = min(states[s] for s in ("", "a") if s in states)
        turns = {t for t, _, _ in out if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(out))
        sha = hashlib.sha256("\n".join(messages).encode()).hexdigest()
        return (conv_id, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha)

    groups = {}
    for c, *row in rows:
        groups.setdefault(c, []).append(row)
    return Counter(digest(c, r) for c, r in groups.items())


def test_conversations_of_every_kind(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "and then", "", " \n", None, "é ñ 漢字?", "x" * 50_000, "so\n."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += rows[:40]
    frame = spark.createDataFrame([(*r, "h", 3, "x") for r in rows], TURNS)
    got = Counter(tuple(r) for r in conversations.digest(frame.repartition(5)).collect())
    assert got == plain_repair(rows)
    assert conversations.digest(frame.where("false")).count() == 0


@pytest.fixture
def uncoalesced(spark):
    """Small tables stay in as many tasks as large ones would."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "19"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_conversation_over_many_tasks(spark, uncoalesced):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "no", f"So {t}.", f"So {t}.", f"and {t}", ""])) for t in range(30_000)] + [(8, 1, "user", "Hm."), (6, 1, "user", "Hm.")]
    frame = spark.createDataFrame([(*r, "h", 3, "x") for r in rows], TURNS)
    scanned = conversations.dealt(conversations.damaged(frame)).mapInArrow(conversations._scan(False), conversations._SCANNED_DDL)
    assert scanned.where("conv_id = 7 and not whole").select("part").distinct().count() > conversations.FAN_IN
    assert Counter(tuple(r) for r in conversations.digest(frame).collect()) == plain_repair(rows)


def test_rows_alike_are_counted(spark, uncoalesced):
    rows = [(1, 2, "user", "Again.")] * 25_000 + [(1, 1, "user", "First."), (1, 3, "assistant", "Last.")]
    frame = spark.createDataFrame([(*r, "h", 3, "x") for r in rows], TURNS)
    made = collapsed(frame)
    assert made.count() == 5 and made.agg(F.sum("copies")).first()[0] == len(rows)
    assert Counter(tuple(r) for r in conversations.digest(frame).collect()) == plain_repair(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "Anyone?"), (1, 3, "assistant", "Yes."), (1, 4, "assistant", "Yes."), (2, 0, "assistant", "Late."), (3, 0, "user", " ")]
    got = sorted(map(tuple, conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    one = [r for r in got if r[0] == 1]
    assert [(p, r) for _, p, r, _ in one] == [(0, "system"), (1, "user"), (2, "assistant"), (3, "user"), (4, "assistant")][: len(one)] and one[0][3] == "Be kind."
    assert [r[2] for r in got if r[0] == 2] in (["user", "assistant"], []) and not [r for r in got if r[0] == 3]


# resampling


def grams(text, order):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return ws, [" ".join(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1)]


@pytest.mark.parametrize("order", [1, 2, 4])
def test_crcs_are_those_of_the_strings(order):
    rng = random.Random(order)
    texts = [" ".join("".join(rng.choice("abZ0É漢-") for _ in range(rng.choice([1, 3, 9, 300]))) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    crc, owner, n = importance.codes([t.encode() for t in texts], order)
    want = Counter((i, zlib.crc32(g.encode())) for i, t in enumerate(texts) for g in grams(t, order)[1])
    assert Counter(zip(owner.tolist(), crc.tolist(), strict=True)) == want
    assert n.tolist() == [len(grams(t, order)[0]) for t in texts]


def plain_ranks(docs, target, percent, least, buckets=10_000, order=2):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in xs for g in grams(x, order)[1]) for xs in ([d[1] for d in docs], target))
    out = []
    for doc, text in docs:
        ws, gs = grams(text, order)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in map(bucket, gs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def test_ranks_equal_a_plain_version(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdÉ9") for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 5, 25, 60])))) for i in range(120)] + [(None, " ".join(word() for _ in range(40))), (500, None), (501, ""), (502, "- -\0-"), (503, "Word " * 40_000)]
    docs += docs[:30]
    target = [" ".join(word() for _ in range(50)) for _ in range(9)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], DOCS).repartition(4)
    bench = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    assert Counter(tuple(r) for r in importance.ranked(frame, bench).collect()) == plain_ranks(docs, target, 25, 20)
    got = importance.ranked(frame, bench, 60, 3, order=3, buckets=97).collect()
    assert Counter(tuple(r) for r in got) == plain_ranks(docs, target, 60, 3, 97, 3)
    none = bench.where("false")
    assert Counter(tuple(r) for r in importance.ranked(frame, none).collect()) == plain_ranks(docs, [], 25, 20)
    empty = frame.where("false")
    assert importance.ranked(empty, bench).count() == importance.drawn(empty, bench).count() == 0
    drawn = importance.drawn(frame, bench)
    assert drawn.columns == frame.columns
    ranks = [r for r in importance.ranked(frame, bench).collect() if r.rank]
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in ranks} and drawn.count() >= len(ranks)


def test_resampling_prefers_the_target(spark):
    docs = [(i, ("apple pear plum " if i % 4 == 0 else "iron zinc lead ") * 10) for i in range(400)]
    bench = spark.createDataFrame([("apple pear plum " * 20,)], "text string")
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], DOCS)
    drawn = {r.doc_id for r in importance.drawn(frame, bench).collect()}
    assert len(drawn) == 100 and sum(d % 4 == 0 for d in drawn) >= 70


# archives


def plain_pages(rows, least=0):
    out = []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    stored = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        first = len(payload) < least or payload not in stored
        if len(payload) >= least:
            stored.setdefault(payload, page)
        out.append((page, len(payload), warc.sha1(payload), "response" if first else "revisit", None if first else stored[payload]))
    return Counter(out)


def test_pages_there_and_back(spark):
    rng = random.Random(9)
    bodies = ["<p>é 漢字</p>", "", None, "a\r\n\r\nWARC/1.1\r\n\r\n", "x" * 3_000_000, "page_id: 99\r\n", "short"]
    rows = [(rng.choice([None, *range(300)]), rng.choice(["http://a.example/x?y=1", "https://b.example", None, "", "odd url\r\nX: 1"]), rng.choice(bodies)) for _ in range(80)]
    rows += rows[:25] + [(k, "http://a.example/", f"<p>{k}</p>") for k in range(1000, 1060)]
    frame = spark.createDataFrame([(*r, "k", 5, 6) for r in rows], PAGES).repartition(5)
    for least in (0, 6):
        assert Counter(tuple(r) for r in warc.round_trip(frame, least).collect()) == plain_pages(rows, least)
    assert warc.round_trip(frame.where("false")).count() == 0


def test_payload_of_most_pages_is_spread(spark, tmp_path, uncoalesced):
    """One payload in nine tenths of the rows: many tasks write it, one as the response; very many rows alike travel as counts."""
    rows = [(k, "http://a.example/", "same" if k % 10 else f"own {k}") for k in range(4_000)] + [(77, "http://b.example/", "same")] * 11_000
    frame = spark.createDataFrame([(*r, "k", 5, 6) for r in rows], PAGES)
    manifest = warc.write(frame, f"file://{tmp_path}/w", file_bytes=200_000)
    records = warc.read(manifest)
    assert records.where("type = 'response'").groupBy("digest").count().where("count > 1").isEmpty()
    assert records.groupBy("type").count().orderBy("type").collect()[0].type == "metadata" and manifest.count() > 4
    assert Counter(tuple(r) for r in warc.resolved(warc.page_of(warc.captures(records))).select("page_id", "payload_bytes", "digest", "type", "refers_to_page").collect()) == plain_pages(rows)


def put(path, *records):
    path.write_bytes(b"".join(records))
    return f"file://{path}"


def test_assembly_in_every_direction(spark, tmp_path):
    """Response names the request, metadata names the request, another names the response from another file, folded headers, a record that nothing names."""
    rec = lambda kind, name, block=b"", **h: warc.record(kind, name, [(k.replace("_", "-"), v) for k, v in h.items()], block)
    http = b"HTTP/1.1 200 OK\r\n\r\nhello"
    one = put(tmp_path / "a.warc", rec("response", "r:1", http, Content_Type="application/http;\r\n msgtype=response", WARC_Concurrent_To="<q:1>"), rec("request", "q:1", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http"), rec("metadata", "m:lost", b"x", WARC_Concurrent_To="<nothing>"))
    two = put(tmp_path / "b.warc", rec("metadata", "m:2", b"page_id: 5\r\n", WARC_Concurrent_To="<q:1>"), rec("metadata", "m:1", b"page_id: -4\r\n", WARC_Concurrent_To="<r:1>"), rec("response", "r:2", http))
    paths = spark.createDataFrame([(one,), (two,)], "path string")
    got = {r.record_id: r for r in warc.page_of(warc.captures(warc.read(paths))).collect()}
    assert {k: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata], r.page_id) for k, r in got.items()} == {"r:1": (["q:1"], ["m:1", "m:2"], -4), "r:2": ([], [], None)}
    assert got["r:1"].payload == b"hello" and got["r:1"].http_head == "HTTP/1.1 200 OK\r\n\r\n"


def test_damage_is_told(tmp_path):
    good = warc.record("response", "r:1", [("Content-Type", "application/http"), ("WARC-Payload-Digest", "sha1:" + warc.sha1(b"hello"))], b"HTTP/1.1 200 OK\r\n\r\nhello")
    packed = lambda b: (lambda z: z.compress(b) + z.flush())(zlib.compressobj(4, zlib.DEFLATED, 31))

    def rows(data, gz):
        path = tmp_path / "x"
        path.write_bytes(data)
        with open(path, "rb") as f:
            return [warc.fields(*r) for r in warc.parsed(warc.Source(f, gz, 7))]

    assert rows(good, False) == rows(packed(good), True) and len(rows(packed(good) * 3, True)) == 3
    for bad, gz in ((good.replace(b"hello", b"jello"), False), (good[:-9], False), (packed(good)[:-12], True), (b"x" + good, False)):
        with pytest.raises(ValueError):
            rows(bad, gz)


def test_tables_of_the_test_data(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in read(spark, sf, "pages").collect()]
    assert Counter(tuple(r) for r in queries.op13_warc(spark, sf).collect()) == plain_pages(pages)


# secrets: forms of assignment, and time

FORMS = [
    "{n}: str = '{v}'", 'const {n}: string = "{v}";', 'let {n}: Option<String> = Some("{v}");', "{n}: Optional[str] | None = '{v}'", "def f({n}: str = '{v}', k=1): pass", "{n} =\n    '{v}'", '{n} = (\n  "{v}"\n)', '{n}: ["{v}"]',
    "{n} = os.getenv('SOME_ENTRY_9', '{v}')", "{n} = env.get('SOME_ENTRY_9', \"{v}\")", '{n} = encrypt(key, "{v}")', '{n} = f(a, "x", b, "{v}")', '"{n}": "Bearer {v}"', "<{n}>{v}</{n}>", '<{n} kind="x">{v}</{n}>', "if ok: {n} = '{v}'", '{n} := "{v}"', "{n}={v}", '"{n}" => "{v}"', "part = '{v}'\n{n} = part",
]
NAMES = ["db_password", "apiToken", "CLIENT_SECRET", "x-auth-token", "signingKey_secret"]
HARMLESS_TEXTS = ["password: str = None", "const tokenCount: number = 12345678;", 'password = input("Enter your password: ")', 'token_url = "https://example.org/Xy9!zz"', "secret: ${SECRET_REF}", 'x = {"token": {"nested": 1}}', "<password></password>", "a: b = 'Xk9!pq2Zw7'", 'token = os.getenv("APP_TOKEN_NAME_9")']


@pytest.mark.parametrize("form", FORMS)
def test_forms_of_assignment(form):
    rng = random.Random(form)
    for name in NAMES:
        value = "".join(rng.choice("abcXYZ0189!%^") for _ in range(11)) + "aZ9!"
        before, after = rng.choice(["", "# note\n", "x = 1\n"]), rng.choice(["", "\nend", "\ny: 2"])
        text = before + form.format(n=name, v=value) + after
        base, spans = secrets.scan(text)
        at = text.index(value)
        assert [s for s in spans if s[1] < 3] == base
        assert any(s <= at and at + len(value) <= e for s, k, e in spans), (text, secrets.shown(spans))
        assert value not in secrets.redacted(text, spans)
        assert all(text[s:e] == value for s, k, e in spans if k >= 3), (text, secrets.shown(spans))


@pytest.mark.parametrize("text", HARMLESS_TEXTS)
def test_harmless_assignments_have_no_more_than_the_base(text):
    base, spans = secrets.scan(text)
    assert spans == base


def test_merged_spans_equal_all_pairs():
    """One pass says the same as a look at every base span."""
    rng = random.Random(12)
    for _ in range(60):
        text = "\n".join(rng.choice(FORMS).format(n=rng.choice(NAMES), v="".join(rng.choice("abcXYZ019!/+") for _ in range(rng.randint(3, 20)))) for _ in range(rng.randint(1, 12)))
        base, want = secrets.base_spans(text), []
        for s, k, e in secrets.lexed_spans(text):
            if not any(a <= s and e <= b for a, _, b in base) and not any((a, b) == (s, e) for a, _, b in want):
                want.append((s, k, e))
        assert secrets.scan(text) == (base, sorted(base + want))


def test_time_grows_as_the_text():
    import time

    def took(n):
        text = "\n".join(f"API_TOKEN_{i}=abcDEF{i}ghi!jk" for i in range(n)) + "x='" * n + "<token>" * n
        began = time.process_time()
        secrets.scan(text)
        return time.process_time() - began

    took(2_000)
    assert took(64_000) < 40 * max(took(4_000), 0.05)
