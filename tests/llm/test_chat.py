import hashlib
import random

from pingscape.llm import catalog, chat

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["\\", "#", "### ", "###", " ", "<", "/", "turn>", "</turn>", "<part ", "0 image 3>", "\n", "x", ":", "Assistant:", "é"]


def test_round_trip_of_control_strings():
    rng = random.Random(5)
    for _ in range(20_000):
        turns = [("".join(rng.choice(BITS) for _ in range(rng.randint(0, 3))), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(1, 3))]
        assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)
        written = "".join(chat.write_turn(r, t, chat.PartVisitor())[0] for r, t in turns)
        assert [(r, t) for r, t, _, _ in chat.read_turns(written)] == turns


def test_plain_text_is_unchanged():
    assert chat.escape("a # b < c > d \\ e") == "a # b < c > d \\ e"


def test_typed_parts():
    parts = [
        {"type": "text", "text": "look <"}, {"type": "text", "text": "/turn> \\"},
        {"type": "image", "ref": "s3://a", "width": 57, "height": 28}, {"type": "audio", "ref": "b", "seconds": 1.5},
        {"type": None, "text": "and"}, {"type": "document", "ref": "c", "pages": 3}, {"type": "image", "ref": None},
    ]
    v = chat.PartVisitor()
    written, a, b = chat.write_turn("user", parts, v)
    assert [(x["number"], x["kind"], x["ref"], x["tokens"]) for x in v.attachments] == [(0, "image", "s3://a", 3), (1, "audio", "b", 38), (2, "document", "c", 768), (3, "image", None, 0)]
    assert chat.read_parts(written[a:b]) == [("text", "look </turn> \\"), ("image", 0, 3), ("audio", 1, 38), ("text", "and"), ("document", 2, 768), ("image", 3, 0)]


def test_plain_texts_are_visited():
    class Recorder(chat.PartVisitor):
        def visit_all(self, parts):
            seen.append(parts)
            return super().visit_all(parts)

    seen = []
    assert [chat.write_turn("user", c, Recorder())[0] for c in ("a </turn>", "", None)] == ["### user:\na \\</turn>\n</turn>\n", "### user:\n\n</turn>\n", "### user:\n\n</turn>\n"]
    assert seen == [[{"type": "text", "text": "a </turn>"}], [{"type": "text", "text": ""}], []]


def test_random_parts_round_trip():
    rng = random.Random(6)
    for _ in range(5000):
        parts, want = [], []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                t = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 6)))
                parts.append({"type": "text", "text": t})
                if want and want[-1][0] == "text":
                    want[-1] = ("text", want[-1][1] + t)
                else:
                    want.append(("text", t))
            else:
                parts.append({"type": "document", "pages": 1})
                want.append(("document", sum(w[0] == "document" for w in want), 256))
        written, a, b = chat.write_turn("u", parts, chat.PartVisitor())
        assert chat.read_parts(written[a:b]) == (want or [("text", "")])


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (2, None, None, "no turn"), (2, 5, "assistant", "### x </turn>"),
            (None, 0, "assistant", "no id"), (3, -300, "user", "early"), (3, 0, "assistant", "l" * 200_000), (3, 700, "system", "late\\"), (4, 0, "assistant", "\\### Assistant: </turn> ok")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(1500)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", segment string, formatted string")
    formatted = chat.format_conversations(df)
    assert formatted.where("conv_id = 5").count() == 6  # a long conversation is several segments
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(formatted).collect()}
    assert got == expected(rows)


def test_null_and_repeated_turns_are_cut_into_pieces(spark):
    rows = [(1, None, "assistant" if i % 3 else "user", f"null {i:04d}") for i in range(1000)]
    rows += [(1, 7, "assistant", f"again {i:04d}") for i in range(700)]
    rows += [(2, None, "assistant", "long " * 60_000 + f"{i}") for i in range(12)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    pieces = formatted.collect()
    assert max(sum(1 for _ in chat.read_turns(p.formatted)) for p in pieces) <= chat.SEGMENT_TURNS
    assert max(len(p.formatted) for p in pieces) < chat.PIECE_CHARS + 400_000
    assert len({(p.conv_id, p.segment, p.piece) for p in pieces}) == len(pieces)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digests(formatted).collect()} == expected(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    got = {r.conv_id: tuple(r)[1:5] for r in catalog.op10_chat_formatting(spark, sf).collect()}
    assert got == expected(rows)
    assert got[-7][2] == len(hard)


def test_parts_column(spark):
    df = spark.createDataFrame([(1, 0, "user", [("text", "see", None, None, None, None, None), ("image", None, "r", 28, 28, None, None)]), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content array<{chat.PART_TYPE}>")
    r = chat.format_conversations(df, content_col="content").collect()[0]
    assert r.attachment_tokens == 1 and r.attachments[0].ref == "r" and r.loss == []


def test_empty_table(spark):
    empty = chat.format_conversations(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and chat.digests(empty).collect() == []


def test_a_run_of_backslashes_is_read_in_linear_time():
    import time

    start = time.time()
    for tail in ("", "### x", "</turn>", "y"):
        text = "\\" * 1_000_000 + tail
        assert chat.unescape(chat.escape(text)) == text
    assert time.time() - start < 4
