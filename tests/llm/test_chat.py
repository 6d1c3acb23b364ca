import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltstream.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, rank long, node string"


def expected(rows):
    """What read_back must give, from the turns in order."""
    said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in rows)
    learned = "".join(text or "" for _, role, text in rows if role == "assistant")
    return (
        len(rows),
        hashlib.sha256(said.encode()).hexdigest(),
        len(learned),
        hashlib.sha256(learned.encode()).hexdigest(),
    )


@given(st.text(alphabet='\\#</turn>: eh\n"ü', max_size=30))
def test_escapes_are_reversible_and_hide_the_marks(text):
    safe = chat.escaped(text)
    assert chat.unescaped(safe) == text
    assert "###" not in safe and "</turn>" not in safe
    assert chat.unescaped(chat.escaped(text, chat.ROLE_ESCAPES)) == text


@pytest.fixture
def rows(rng):
    out = []
    for conv in range(60):
        turns = [("system", "be brief"), ("user", f"question {rng.randrange(3)}")]
        turns += [(rng.choice(["assistant", "user", None]), rng.choice(["yes", "no", None, "ü###\\</turn>"])) for _ in range(rng.randrange(4))]
        out += [(conv, k, role, text, 1, "x") for k, (role, text) in enumerate(turns)]
    out += [(100, 0, "user", "q", 1, "x")] * 2  # a repeated row is a turn of its own
    out += [(101, k, "user", "", 1, "x") for k in range(300)]  # a long conversation
    out += [(None, 0, "user", "lost", 1, "x"), (102, None, "assistant", "first", 1, "x"), (102, 0, "user", "second", 1, "x")]
    return out


def test_conversations_are_read_back(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    segments, paths = chat.format_conversations(table)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(segments, paths).collect()}
    by_conv = {}
    for conv, turn, role, text, *_ in rows:
        by_conv.setdefault(conv, []).append((-1 if turn is None else turn, role, text))
    assert got == {conv: expected(sorted(turns, key=lambda t: t[0])) for conv, turns in by_conv.items()}


def test_tree_is_depth_first_and_attends_to_ancestors(spark, rows):
    segments, paths = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    segments = sorted(segments.collect(), key=lambda s: s.start)
    ends, nodes = 0, {}
    for s in segments:  # every token once, without gaps
        assert s.start == ends
        ends += len(s.ids)
        nodes[bytes(s.node)] = s
    routes = {}
    for r in paths.collect():
        routes.setdefault(r.conv_id, []).append((r.depth, bytes(r.node)))
    assert len(nodes) == len({tuple(n for _, n in sorted(p)[: k + 1]) for p in routes.values() for k in range(len(p))})
    below = {}
    for route in routes.values():
        route = [nodes[n] for _, n in sorted(route)]
        for k, s in enumerate(route):
            assert s.position_start == sum(len(a.ids) for a in route[:k])
            seen = {t for a in s.attends for t in range(a.start, a.end)}
            assert seen == {t for a in route[:k] for t in range(a.start, a.start + len(a.ids))}
            below.setdefault(bytes(s.node), set()).update(range(s.start, s.start + len(s.ids)))
            for a in route[:k]:
                below[bytes(a.node)].update(range(s.start, s.start + len(s.ids)))
    for tokens in below.values():  # a subtree is contiguous
        assert len(tokens) == max(tokens) - min(tokens) + 1


def test_no_conversations(spark):
    segments, paths = chat.format_conversations(spark.createDataFrame([], SCHEMA))
    assert chat.read_back(segments, paths).collect() == [] and segments.count() == 0
