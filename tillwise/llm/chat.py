"""Chat formatting: conversations rebuilt from an event log and rendered with a template.

Events have conv_id, seq (order in the conversation's log), turn, role, action and text:

* ``message``: a whole message of the turn; several of one turn all stay;
* ``delta``: a streamed piece, appended to the streamed message of the turn;
* ``edit``: takes the place of everything that the turn had before;
* ``regenerate``: takes away what the turn and the turns after it had before.

An event counts unless a later edit of its turn, or a later regeneration of its turn or one
before, takes it away. The log is partitioned by conversation once; both rules are running
maxima in it. A conversation becomes one row of the result, so it has to fit a row.

Template: ``<s>role\\ntext</s>`` for each turn, the text of users inside ``[INST]``. A control
string inside a text gets a backslash after its first character, one that already has
backslashes there gets one more; taking one away restores the text exactly.

Defined cases: null texts and roles are empty; null turns, sequence numbers and conversation
ids come first and form their own group; a null or unknown action is a message; rows with
equal order are ordered by role and text, so repeated rows all stay; an empty log gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
TURN_START, TURN_END = "<s>", "</s>"
USER_START, USER_END = "[INST] ", " [/INST]"
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
USER, ASSISTANT = "user", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    """A role must not hold the line feed that ends it."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))), "\\")


def whole_messages(conversations: DataFrame) -> DataFrame:
    """A table of finished messages (conv_id, turn, role, text) as a log."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", "role", F.lit("message").alias("action"), "text")


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id and turns: array of (role, text), in order."""
    edited = F.when(F.col("action") == "edit", F.col("seq"))
    restarted = F.when(F.col("action") == "regenerate", F.col("seq"))
    of_turn = Window.partitionBy("conv_id", "turn")
    up_to_turn = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken_away = (F.coalesce(F.col("seq") < F.col("edit_seq"), F.lit(False))) | (
        F.coalesce(F.col("seq") < F.col("restart_seq"), F.lit(False))
    )
    streamed = F.col("action").isin("delta", "edit", "regenerate")
    live = (
        events.select(
            "conv_id",
            "seq",
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("action", F.lit("message")).alias("action"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumns({"edit_seq": F.max(edited).over(of_turn), "restart_seq": F.max(restarted).over(up_to_turn)})
        .filter(~taken_away)
    )
    pieces = F.sort_array(
        F.collect_list(F.struct("turn", streamed.alias("streamed"), "seq", "role", "text"))
    )
    log = live.groupBy("conv_id").agg(pieces.alias("pieces"))
    # A piece opens a message unless it goes on with the streamed message of its turn.
    indexed = log.select(
        "conv_id",
        "pieces",
        F.filter(
            F.transform(
                "pieces",
                lambda p, i: F.when(
                    p.streamed
                    & (i > 0)
                    & F.get("pieces", i - 1).streamed
                    & F.get("pieces", i - 1).turn.eqNullSafe(p.turn),
                    F.lit(None),
                ).otherwise(i),
            ),
            lambda i: i.isNotNull(),
        ).alias("opens"),
    )
    return indexed.select(
        "conv_id",
        F.transform(
            "opens",
            lambda start, k: F.struct(
                F.col("pieces")[start].role.alias("role"),
                F.array_join(
                    F.transform(
                        F.slice("pieces", start + 1, F.coalesce(F.get("opens", k + 1), F.size("pieces")) - start),
                        lambda p: p.text,
                    ),
                    "",
                ).alias("text"),
            ),
        ).alias("turns"),
    )


def render(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss: the rendered conversation, and which of its turns are learned.

    ``loss`` has one entry per turn: start and end of the learned text within the rendered
    turn (code points, end exclusive), or null.
    """
    def shown(turn: Column) -> Column:
        body = F.when(turn.role == USER, F.concat(F.lit(USER_START), escape(turn.text), F.lit(USER_END)))
        head = F.concat(F.lit(TURN_START), _escape_role(turn.role), F.lit("\n"))
        return F.concat(head, body.otherwise(escape(turn.text)), F.lit(TURN_END))

    def learned(turn: Column) -> Column:
        start = F.lit(len(TURN_START)) + F.length(_escape_role(turn.role)) + 1
        end = start + F.length(escape(turn.text))
        return F.when(turn.role == ASSISTANT, F.struct(start.alias("start"), end.alias("end")))

    return turns.select(
        "conv_id", F.array_join(F.transform("turns", shown), "").alias("formatted"), F.transform("turns", learned).alias("loss")
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns and learned texts from the rendered text and the loss mask alone."""
    split = rendered.select("*", F.split("formatted", TURN_END, -1).alias("parts"))
    cut = split.select("*", F.slice("parts", 1, F.size("parts") - 1).alias("shown"))

    def turn(part: Column) -> Column:
        role_end = F.instr(part, F.lit("\n"))
        role = _unescape_role(F.substring(part, F.lit(len(TURN_START) + 1), role_end - len(TURN_START) - 1))
        body = F.substring(part, role_end + 1, F.length(part))
        inner = F.substring(body, F.lit(len(USER_START) + 1), F.length(body) - len(USER_START) - len(USER_END))
        return F.struct(role.alias("role"), unescape(F.when(role == USER, inner).otherwise(body)).alias("text"))

    def under_mask(part: Column, i: Column) -> Column:
        span = F.col("loss")[i]
        return F.coalesce(unescape(F.substring(part, span.start + 1, span.end - span.start)), F.lit(""))

    return cut.select(
        "conv_id",
        "formatted",
        F.transform("shown", turn).alias("turns"),
        F.array_join(F.transform("shown", under_mask), "").alias("loss_text"),
    )


def digests(back: DataFrame) -> DataFrame:
    """Counts and digests of what :func:`read_back` returns."""
    line = lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted and loss of every conversation of an event log."""
    return render(reconstruct(events))
