"""Chat formatting, conversation repair and cross-tokenizer alignment against plain readings of their rules."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscan.llm import alignment, chat_format, conversation_repair
from folioscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "system", "Be ~0 kind~1. <<SYS>><</SYS>>"), (1, 1, "user", "</s>[INST] hi [/INST]"), (1, 2, "assistant", "<s>[ROLE]x[/ROLE]~</s>"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, None, "user", "no turn."), (2, 0, None, "no role"), (2, 0, "tool [/ROLE]~", "x\ny"), (2, 1, "assistant", "\n"), (3, 5, "assistant", "a."), (3, 5, "assistant", "a."), (3, 9, "user", "é日😀?"),
    (None, 0, "user", "nobody's."), (None, 1, "assistant", "really?"), (4, 0, "user", " \t"), (5, 0, "", "empty role"), (6, 3, "user", "x" * 70_000 + "[INST]" * 3_000), (6, 4, "assistant", "yes! " * 9_000),
]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture
def talks(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"TURNS": F.lit("x"), "Formatted": F.lit(1), "_f": F.lit(2), "digest": F.lit(None)}).repartition(3)


def by_turn(rows):
    """Rows of each conversation in order."""
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return {c: sorted(x, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")) for c, x in out.items()}


def test_formatting_comes_back(spark, talks):
    examples = chat_format.expand(chat_format.format_conversations(talks))
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    made = defaultdict(list)
    for r in examples.orderBy("example").collect():
        made[r.conv_id].append(r)
    want = by_turn(ODD)
    assert set(got) == set(want)
    for c, rows in want.items():
        replies = [r[3] or "" for r in rows if r[2] == "assistant"]
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(rows), sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in rows)))
        assert (r.loss_chars, r.loss_sha256) == (len("".join(replies)), sha("".join(replies)))
        assert r.formatted_chars == sum(len(x.text) for x in made[c]) and len(made[c]) == r.n_examples
        assert len(made[c]) == len(replies) + (rows[-1][2] != "assistant")
        for x, y in itertools.pairwise(made[c]):
            assert y.text.startswith(x.text) and x.hi < len(x.text) and x.hi <= y.lo  # all before is context, a reply is trained once
        assert sum(x.hi > x.lo for x in made[c]) == sum(x != "" for x in replies)
    first = made[1][0]
    assert first.text == "<<SYS>>Be ~00 kind~01. <~1<SYS>><~1</SYS>><</SYS>>[INST] <~1/s>[~1INST] hi [~1/INST] [/INST]<s> <~1s>[~1ROLE]x[~1/ROLE]~0<~1/s> </s>"


def test_escapes_are_reversible_and_complete(spark):
    rng = random.Random(4)
    bits = ["<", ">", "[", "]", "/", "~", "0", "1", "s", "INST", "ROLE", "SYS", "</s>", "[INST]", "<<SYS>>", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not re.search(r"\[/?(INST|ROLE)\]|<</?SYS>>|</?s>", r.e)


def test_formatting_is_native_and_shuffles_once(spark):
    plan = QUERIES["op11_prefix_targets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def plain_repair(kinds):
    """(cost, ASCII-least labels) by trying all label strings that cost no more than the cheapest."""
    heap, least, found = [(0, "", 0, 0)], None, set()
    while heap:
        cost, said, i, q = heapq.heappop(heap)
        if least is not None and cost > least:
            break
        if i == len(kinds) and q in (0, 3):
            least = cost
            found.add(said)
        wants = ["su", "u", "a", "u"][q]
        steps = [("I", 3, i, "?sua".index(r)) for r in wants if r != "s"]
        steps = [(x, c, j, {1: 1, 2: 2, 3: 3}[p]) for x, c, j, p in steps]
        if i < len(kinds):
            initial, fault = kinds[i]
            steps.append(("D", 4, i + 1, q))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if initial and initial in wants:
                    steps.append(("K", more, i + 1, "?sua".index(initial)))
                steps += [("R", 3 + more, i + 1, "?sua".index(r)) for r in wants if r != "s"]
        for label, c, j, p in steps:
            if cost + c <= 4 * len(kinds):
                heapq.heappush(heap, (cost + c, said + label, j, p))
    return least, min(found)


def test_shortest_path_equals_all_paths():
    rng = random.Random(3)
    for _ in range(1500):
        kinds = [(rng.choice(["s", "u", "u", "a", "a", "x", ""]), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 6))]
        assert conversation_repair.repair(kinds) == plain_repair(kinds), kinds


def plain_report(rows):
    """Every conversation by the letter of the rules, the path by dynamic programming over whole strings from the end."""
    ids, left = {r[0] for r in rows}, defaultdict(list)
    for c, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        left[c] += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = {}
    for c in ids:
        at = sorted(left[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        kinds, seen = [], set()
        for _, role, text in at:
            tail = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            kinds.append((role[:1], "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail not in ".!?" else ""))
            seen.add((role, text))
        ahead = {q: (0, "") if q in (0, 3) else (10**9, "") for q in range(4)}

        def inserts(d):
            for _ in range(4):
                for q, wants in enumerate(["su", "u", "a", "u"]):
                    for r in wants.replace("s", ""):
                        cost, said = d["?sua".index(r)]
                        d[q] = min(d[q], (cost + 3, "I" + said))
            return d

        ahead = inserts(ahead)
        for initial, fault in reversed(kinds):
            now = {}
            for q, wants in enumerate(["su", "u", "a", "u"]):
                ways = [(4 + ahead[q][0], "D" + ahead[q][1])]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    for r in wants:
                        cost, said = ahead["?sua".index(r)]
                        ways += [(cost + more, "K" + said)] * (r == initial) + [(cost + more + 3, "R" + said)] * (r != "s")
                now[q] = min(ways)
            ahead = inserts(now)
        cost, audit = ahead[0]
        n, body, rest = sum(x != "D" for x in audit), [], iter(at)
        roles = ["s"] * (n % 2) + ["user", "assistant"] * (n // 2)
        for x in audit:
            row = ("", "", "") if x == "I" else next(rest)
            if x != "D":
                body.append(f"{row[1] if x == 'K' else roles[len(body)]}:{row[2] if x != 'I' else ''}")
        turns = {r[0] for r in at} - {None}
        counts = [sum(k[1] == f for k in kinds) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha("\n".join(body)))
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("source", ["odd", SF])
def test_repair_equals_the_rules(spark, talks, source):
    df = talks if source == "odd" else spark.read.parquet(f"{source}/conversations.parquet")
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in conversation_repair.report(df).collect()}
    assert got == plain_report([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_rows_follow_the_grammar(spark):
    rows = conversation_repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    plans = conversation_repair.plan(rows)
    hashes = {r.conv_id: r.repaired_sha256 for r in conversation_repair.digests(rows, plans).collect()}
    found = defaultdict(list)
    for r in conversation_repair.repaired(rows, plans).collect():
        found[r.conv_id].append((r.position, r.role, r.text))
    assert len(found) > 10
    for c, x in found.items():
        x.sort()
        assert re.fullmatch("(s?(ua)+)?", "".join(r[1][0] for r in x)) and hashes[c] == sha("\n".join(f"{r[1]}:{r[2]}" for r in x))


def test_a_very_long_conversation_is_one_pass(spark):
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    r = conversation_repair.plan(rows).first()
    assert r.audit == "K" * 60_000 and r.cost == 0


def naive_alignment(rows, first, second):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(first), SentencePieceProcessor(model_file=second)
    a.encode_special_tokens = True
    table = {c: i for i, c in enumerate(range(256))}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in table if x not in plain)}
    docs, count = [], Counter()
    for doc_id, text in rows:
        links, groups = [], []
        xs = ys = []
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            xs = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in e.ids]
            ys = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            whole = (" " + text).encode()
            if b"".join(y for _, y in ys) != whole or b"".join(x for _, x in xs) != whole:
                xs = ys = []
        i = j = start_x = start_y = 0
        ga, gb = [], []
        while i < len(xs):
            if not ga:
                ga.append(xs[i][0])
                gb.append(ys[j][0])
                links.append((xs[i][0], ys[j][0]))
            end_x, end_y = start_x + len(xs[i][1]), start_y + len(ys[j][1])
            if end_x == end_y:
                groups.append((ga, gb))
                ga, gb, i, j, start_x, start_y = [], [], i + 1, j + 1, end_x, end_y
                continue
            if end_x < end_y:
                i, start_x = i + 1, end_x
                ga.append(xs[i][0])
            else:
                j, start_y = j + 1, end_y
                gb.append(ys[j][0])
            links.append((xs[i][0], ys[j][0]))
        count.update(set(links))
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((doc_id, len(xs), len(ys), len(groups), links, sha(said) if xs else ""))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    return Counter((d, na, nb, ng, len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), h) for d, na, nb, ng, ls, h in docs), count


def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    rng = random.Random(5)
    bits = [" ", "\n", "\t", "a", "b", "é", "日", "'s", "▁", "!", "1", "\x1c", "\xa0", "　", "<s>", "<|endoftext|>", "\0", "\x85", "  ", "The", "😀", "<0x0A>", "​", "᠎", "\r"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [None, "", " ", "\n", "a ", "same text here", "same text here", "word " * 5000, "unbroken" * 3000, "▁", "x▁y z"]
    return [*enumerate(texts), (None, "nobody's text"), (5, "again five")]


@pytest.mark.parametrize("block", [8_000_000, 300])
def test_alignment_equals_whole_texts(spark, frame, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = odd_texts()
    got = Counter(tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(frame(rows, clash=True), *files()).collect())
    want, pairs = naive_alignment(rows, *files())
    assert got == want
    assert {(r.a, r.b): r.n_docs for r in alignment.pair_counts(frame(rows), *files()).collect()} == pairs


def test_alignment_query_equals_whole_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_group_dictionary"](spark, SF).collect())
    assert got == naive_alignment(rows, *files())[0]


def test_memory_of_units_is_bounded():
    both = alignment.Pair(*files())
    for k in range(6):
        both.block([f"{'z' * 5_000_000}{k}"])
    assert both.held <= alignment.HELD + 10_000_000 and len(both.said) < 10


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], SCHEMA)
    assert chat_format.read_back(chat_format.expand(chat_format.format_conversations(none))).count() == 0
    assert conversation_repair.report(none).count() == 0
    assert alignment.align_documents(frame([(1, "x")]).filter("false"), *files()).count() == 0
