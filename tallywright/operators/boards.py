"""Racks, plays and positions as tables: tiles, leaves and squares by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "?"
#: A tile as written, one character or several in brackets: on a rack, on a board, and in a play.
TILE, BOARD_TILE, PLAY_TILE = r"\[[^\[\]]+\]|[^\[\]]", r"\[[^\[\]\d]+\]|[^\[\]\d]", r"\[[^\[\]]+\]|[^\[\]()]"


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def rack_spelling(rack: Column) -> Column:
    """Upper case, without blanks, in sorted order."""
    return F.array_join(F.array_sort(letters(F.upper(F.regexp_replace(rack, r"\s", "")))), "")


def canonical_rack(rack: Column, alphabet: list[str]) -> Column:
    """Tiles in the alphabet's order, the blank last; tiles of several letters in brackets, longest first."""
    longest = sorted(alphabet, key=lambda x: (-len(x), x))
    tiles = F.regexp_extract_all(F.upper(rack), F.lit("(" + "|".join([rf"\[{x}\]" for x in longest if len(x) > 1] + longest + [r"\?"]) + ")"), F.lit(1))
    plain = F.transform(tiles, lambda t: F.regexp_replace(t, r"[\[\]]", ""))
    place = lambda t: F.when(t == BLANK, len(alphabet) + 1).otherwise(F.array_position(F.lit(alphabet), t).cast("int"))
    ordered = F.array_sort(F.transform(plain, lambda t: F.struct(place(t).alias("p"), F.when(F.length(t) > 1, F.concat(F.lit("["), t, F.lit("]"))).otherwise(t).alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), "")


def rack_tiles(racks: DataFrame) -> DataFrame:
    """(id, letter, n) of every rack."""
    return racks.select("id", F.explode(letters(F.upper("rack"))).alias("letter")).groupBy("id", "letter").agg(F.count("*").alias("n"))


def leave_of(rack: Column, used: Column) -> Column:
    """The rack less the tiles used, in sorted order; lower-case tiles use a blank; null if the rack lacks one."""
    wanted = F.transform(letters(used), lambda x: F.when(x.rlike("^[a-z]$"), BLANK).otherwise(x))

    def take(left: Column, tile: Column) -> Column:
        before = F.call_function("substring_index", left, tile, F.lit(1))
        return F.when(left.contains(tile), F.concat(before, F.substr(left, F.length(before) + 2)))

    return F.aggregate(wanted, rack_spelling(rack), take)


def board_squares(positions: DataFrame) -> DataFrame:
    """(record_id, row, col, tile) of the occupied squares of position strings: rows by '/', numbers count empty squares."""
    board = F.split("position", " ")[0]
    rows = positions.select("record_id", F.posexplode(F.split(board, "/")).alias("row", "line"))
    marks = rows.select("record_id", "row", marks_of(F.col("line")).alias("marks"))
    # the column of a mark is the width of the marks before it
    placed = F.transform("marks", lambda m, i: F.struct(plain_tile(m).alias("tile"), width_of(F.slice("marks", 1, i)).alias("col")))
    return marks.select("record_id", "row", F.explode(F.filter(placed, lambda x: ~x["tile"].rlike(r"^\d+$"))).alias("x")).select("record_id", "row", "x.col", "x.tile")


def marks_of(line: Column) -> Column:
    """Numbers of empty squares and tiles of a board's row."""
    return F.regexp_extract_all(line, F.lit(rf"(\d+|{BOARD_TILE})"), F.lit(1))


def width_of(marks: Column) -> Column:
    """Squares that marks take; null if one counts no square, or more than a number holds."""
    one = lambda m: F.when(m.rlike(r"^\d+$"), F.nullif(m.try_cast("int"), F.lit(0))).otherwise(1)
    return F.aggregate(marks, F.lit(0), lambda n, m: n + one(m))


def plain_tile(tile: Column) -> Column:
    return F.regexp_replace(tile, r"[\[\]]", "")


def tiles_written(text: Column) -> Column:
    """Tiles of a run of letters; null for a stray, nested or empty bracket."""
    tiles = F.transform(F.regexp_extract_all(text, F.lit(f"({TILE})"), F.lit(1)), plain_tile)
    return F.when(text.rlike(f"^(?:{TILE})*$"), tiles)


def position_fields(positions: DataFrame) -> DataFrame:
    """positions with rack1, rack2 (tiles), score1, score2 and zeros (scoreless turns) of their strings, and whether they can be read.

    Fields are split at blanks: a square board, both racks, both scores, the turns; what follows is ignored. Of a string
    that can't be read, or null, all fields are null and `readable` is false.
    """
    fields = F.split(F.trim("position"), r"\s+")
    board, racks, scores = (F.split(F.get(fields, F.lit(i)), "/") for i in range(3))
    zeros, number = F.get(fields, F.lit(3)), r"^-?\d+$"
    square = F.forall(board, lambda r: r.rlike(rf"^(?:\d+|{BOARD_TILE})*$") & F.coalesce(width_of(marks_of(r)) == F.size(board), F.lit(False)))
    two = (F.size(racks) == 2) & (F.size(scores) == 2) & F.forall(racks, lambda r: tiles_written(r).isNotNull()) & F.forall(scores, lambda x: x.rlike(number))
    readable = F.coalesce((F.size(fields) >= 4) & square & two & zeros.rlike(number), F.lit(False))
    given = lambda x: F.when(readable, x)
    of_seat = lambda x, i: F.get(x, F.lit(i))
    return positions.withColumns({
        "readable": readable,
        **{f"rack{i + 1}": given(tiles_written(of_seat(racks, i))) for i in range(2)},
        **{f"score{i + 1}": given(of_seat(scores, i).try_cast("int")) for i in range(2)},
        "zeros": given(zeros.try_cast("int")),
    })


def occupancy(squares: DataFrame) -> DataFrame:
    """How often each square is occupied."""
    return squares.groupBy("row", "col").agg(F.count("*").alias("n"))


def explode_moves(moves: DataFrame) -> DataFrame:
    """Move notation: kind, row, column, direction and tiles; "8D.WORD" lies across, "D8.WORD" down."""
    across, down = r"^(\d{1,2})([A-Za-z])\.(\S+)$", r"^([A-Za-z])(\d{1,2})\.(\S+)$"
    m = F.col("move")
    kind = F.when(m.rlike(across) | m.rlike(down), "place").when(m.rlike(r"^ex\."), "exchange").when(m == "pass", "pass").otherwise("other")
    number = lambda x: x.try_cast("int")
    row = F.when(m.rlike(across), number(F.regexp_extract(m, across, 1))).when(m.rlike(down), number(F.regexp_extract(m, down, 2)))
    col = F.when(m.rlike(across), F.regexp_extract(m, across, 2)).when(m.rlike(down), F.regexp_extract(m, down, 1))
    tiles = F.when(m.rlike(across), F.regexp_extract(m, across, 3)).when(m.rlike(down), F.regexp_extract(m, down, 3)).when(m.rlike(r"^ex\."), F.substr(m, F.lit(4)))
    return moves.select("*", kind.alias("kind"), (row - 1).alias("row"), (F.ascii(F.upper(col)) - 65).alias("col"), F.when(m.rlike(across), "across").when(m.rlike(down), "down").alias("direction"), tiles.alias("tiles"))


def parse_moves(moves: DataFrame) -> DataFrame:
    """moves with kind (play, exchange, pass; null if unreadable), direction, tiles of an exchange and squares of a play.

    "3C FOXY" lies across and "H7 (T)ABLE" down, from row 1 and column A; tiles in parentheses, or each dot, stand on the
    board already (`through`), a dot without its letter. "(exch ABC)" swaps tiles.
    """
    text = F.trim("move")
    across, down, swap = r"^(\d+)([A-Z])\s+(\S+)$", r"^([A-Z])(\d+)\s+(\S+)$", r"^\(exch (.+)\)$"
    is_across, is_down = text.rlike(across), text.rlike(down)
    pick = lambda a, d: F.when(is_across, F.regexp_extract(text, across, a)).when(is_down, F.regexp_extract(text, down, d))
    row, col, word = pick(1, 2).try_cast("int") - 1, F.ascii(pick(2, 1)) - 65, pick(3, 3)
    run = rf"\((?:{PLAY_TILE})*\)|{PLAY_TILE}"
    runs = F.regexp_extract_all(word, F.lit(f"({run})"), F.lit(1))
    tiles_of = lambda r: F.regexp_extract_all(r, F.lit(f"({PLAY_TILE})"), F.lit(1))
    square = lambda r: lambda t: F.struct(F.when(t != ".", plain_tile(t)).alias("letter"), (r.startswith("(") | (t == ".")).alias("through"))
    flat = F.flatten(F.transform(runs, lambda r: F.transform(tiles_of(r), square(r))))
    at = lambda i, ahead: F.when(ahead, i).otherwise(0)
    placed = F.transform(flat, lambda q, i: F.struct((row + at(i, is_down)).alias("row"), (col + at(i, is_across)).alias("col"), q["letter"].alias("letter"), q["through"].alias("through")))
    is_play = F.coalesce((row >= 0) & word.rlike(f"^(?:{run})+$") & (F.size(flat) > 0), F.lit(False))
    swapped = F.when(text.rlike(swap), tiles_written(F.regexp_extract(text, swap, 1)))
    kind = F.when(text == "pass", "pass").when(swapped.isNotNull(), "exchange").when(is_play, "play")
    return moves.withColumns({
        "kind": kind,
        "direction": F.when(is_play, F.when(is_across, "across").otherwise("down")),
        "tiles": swapped,
        "squares": F.when(is_play, placed),
    })


def placed_squares(parsed: DataFrame) -> DataFrame:
    """The squares on which plays put tiles."""
    return parsed.select("*", F.explode(F.filter("squares", lambda q: ~q["through"])).alias("q")).select(*(c for c in parsed.columns if c != "squares"), "q.row", "q.col", "q.letter")


def leave_values(plays: DataFrame, racks: DataFrame) -> DataFrame:
    """Plays and summed equity by leave; plays: id, equity_cents; racks: id, rack, used. Plays are summed by rack before racks lose their tiles."""
    by_rack = plays.groupBy("id").agg(F.count("*").alias("plays"), F.sum("equity_cents").alias("equity_cents"))
    rows = by_rack.join(racks, "id").withColumn("leave", leave_of(F.col("rack"), F.col("used"))).filter("leave is not null")
    return rows.groupBy("leave").agg(F.sum("plays").alias("plays"), F.sum("equity_cents").alias("equity_cents"))
