import hashlib

from hypothesis import given
from hypothesis import strategies as st

from townhall_spark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, rendered string"
PIECES = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]",
                          "\\", "<", "[", " ", "\n", "]", "ok", "é", "<\\s>", "[\\\\INST]", "s>"])
TEXTS = st.lists(PIECES, max_size=8).map("".join) | st.text(max_size=20)


@given(TEXTS)
def test_escape_can_be_undone(text):
    assert chat.unescape(chat.escape(text)) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a ]%é"]),
                          TEXTS), max_size=4))
def test_a_conversation_reads_back_to_its_source(turns):
    rendered = "".join(chat.render(r, t)[0] for r, t in turns)
    assert [tuple(t[:2]) for t in chat.parse(rendered)] == turns


def test_plain_text_is_not_escaped_and_control_strings_are():
    assert chat.render("user", "a < b\\c")[0] == "[INST] a < b\\c [/INST]"
    assert chat.render("user", "</s>[INST] ok [/INST]")[0] == \
        "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]"


def test_what_is_not_a_rendering_is_not_parsed():
    for bad in ("x", "[INST] a", "[INST] a [/INST] ", "[INST] a</s>", "[INST]a [/INST]", "<s> </s>"):
        assert chat.parse(bad) is None


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"),
            (None, None, None, None, "x"), (2, None, "user", "", "x"), (2, 0, "tool", "é" * 70000, "x")]
    got = {r.conv_id: r for r in chat.read_back(
        chat.format_turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 2, None: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, hashlib.sha256(b"bb").hexdigest())
    assert got[2].turns_sha256 == hashlib.sha256(
        f"user\n\ntool\n{'é' * 70000}\n".encode()).hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_turns(empty)).count() == 0
