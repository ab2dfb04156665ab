"""Masking of personal data in raw tables (K1-K7).

Every masked cell is a column expression of a salted SHA-256 digest, so the job is one
projection over the scan and gives the same output under the same salt, whatever the
partitioning. Ids depend on their value alone and keep links between tables; all other
fakes depend on the row key, so equal originals do not stay linkable.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.functions.text import column_name, fold_text, known_text, parse_day_first, parse_money, strip

# What masked cells are made of; any lists would do.
FIRST_NAMES = ("Alba", "Benno", "Cira", "Davi", "Enzo", "Flora", "Gilda", "Hugo", "Iris", "Jonas", "Kira", "Lino")
LAST_NAMES = ("Amaral", "Barreto", "Cardim", "Duarte", "Esteves", "Fontes", "Garrido", "Horta", "Leite", "Moura", "Neves")
STREETS = ("Rua do Moinho", "Rua da Ponte", "Travessa do Cais", "Alameda do Bosque", "Largo da Fonte", "Rua do Farol")
CITIES = ("Vila Nova", "Porto Claro", "Serra Azul", "Monte Belo", "Lagoa Grande", "Campo Verde")
STATES = ("AA", "BB", "CC", "DD", "EE", "FF")

# Words in a column name that choose its rule; the first rule that fits wins.
RULE_WORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("name", ("nome",)),
    ("email", ("email", "e-mail")),
    ("phone", ("telefone", "celular", "fone", "whatsapp")),
    ("document", ("cpf", "cnpj", "documento", "rg")),
    ("postcode", ("cep",)),
    ("address", ("endereco", "logradouro", "rua", "bairro")),
    ("city", ("cidade",)),
    ("state", ("estado", "uf")),
    ("date", ("data", "dt")),
    ("number", ("valor", "preco", "ticket", "qtde", "quantidade", "pontos")),
    ("id", ("id", "codigo", "cod", "pedido", "op")),
)
NOISE = 0.15
MAX_SHIFT_DAYS = 90


def rule_for(name: str) -> str | None:
    """K1: the masking rule of a column, matched on whole words of its normalised name."""
    words = column_name(name).split("_")
    for rule, hints in RULE_WORDS:
        if any(h in words for h in hints):
            return rule
    return None


def digest(salt: str, *parts: Column) -> Column:
    """Hex digest all fakes of one cell are cut from; a null part differs from a blank and from no part.

    The last of two parts needs no length, as the first is a fixed name; of more, each behind the name carries its own, so
    that ("a|b", "c") and ("a", "b|c") differ.
    """
    marked = [F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]
    if len(marked) > 2:
        marked = [marked[0], *[F.concat(F.length(m).cast("string"), F.lit(":"), m) for m in marked[1:]]]
    return F.sha2(F.concat_ws("|", F.lit(salt), *marked), 256)


def draw(hexed: Column, part: int, n: int) -> Column:
    """A number in 0..n-1 from the part-th 8 hex digits of a digest."""
    return F.pmod(F.conv(F.substring(hexed, 8 * part + 1, 8), 16, 10).cast("long"), F.lit(n))


def uniform(hexed: Column, part: int) -> Column:
    """A number strictly between 0 and 1."""
    return (F.conv(F.substring(hexed, 8 * part + 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def choose(hexed: Column, part: int, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(hexed, part, len(values)) + 1).cast("int"))


def pseudonym(c: Column, salt: str) -> Column:
    """K2: stable fake id; blank and spelled-out missing values stay as they are."""
    text = strip(c)
    fake = F.concat(F.lit("ID"), F.substring(digest(salt, text), 1, 16))
    return F.when(c.isNull(), F.lit(None)).when(known_text(c), fake).otherwise(text)


def shifted_date(c: Column, hexed: Column) -> Column:
    """K4: a date moved by up to 90 days either way; unreadable text is left as it is."""
    day = F.to_date(parse_day_first(c))
    moved = F.date_add(day, (draw(hexed, 0, 2 * MAX_SHIFT_DAYS + 1) - MAX_SHIFT_DAYS).cast("int"))
    return F.coalesce(F.date_format(moved, "dd/MM/yyyy"), c)


def noisy_number(c: Column, hexed: Column) -> Column:
    """K5: a number times Normal(1, 0.15), two decimals, comma decimal mark."""
    normal = F.sqrt(-2 * F.ln(uniform(hexed, 0))) * F.cos(2 * math.pi * uniform(hexed, 1))
    fake = F.round(parse_money(c) * (1 + NOISE * normal), 2)
    return F.coalesce(F.translate(fake.cast("decimal(38,2)").cast("string"), ".", ","), c)


def _joined(*parts: Column | str) -> Column:
    """Text from parts; plain concatenation is much cheaper per row than a format string."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _padded(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def _fake(rule: str, c: Column, hexed: Column) -> Column:
    """K3, K6: the replacement of one cell."""
    if rule == "name":
        return F.concat_ws(" ", choose(hexed, 0, FIRST_NAMES), choose(hexed, 1, LAST_NAMES))
    if rule == "email":
        return F.concat(F.lit("cliente"), F.substring(hexed, 1, 12), F.lit("@example.com"))
    if rule == "phone":
        parts = (draw(hexed, 0, 88) + 11, draw(hexed, 1, 9999) + 90000, draw(hexed, 2, 8999) + 1000)
        return _joined("(", parts[0], ") ", parts[1], "-", parts[2])
    if rule == "document":
        groups = [_padded(draw(hexed, i, 1000), 3) for i in range(3)]
        return _joined(groups[0], ".", groups[1], ".", groups[2], "-", _padded(draw(hexed, 3, 100), 2))
    if rule == "postcode":
        return _joined(draw(hexed, 0, 89999) + 10000, "-", draw(hexed, 1, 899) + 100)
    if rule == "address":
        return _joined(choose(hexed, 0, STREETS), ", ", draw(hexed, 1, 989) + 10)
    if rule == "city":
        return choose(hexed, 0, CITIES)
    if rule == "state":
        return choose(hexed, 0, STATES)
    if rule == "date":
        return shifted_date(c, hexed)
    return noisy_number(c, hexed)


def mask_table(
    df: DataFrame,
    salt: str,
    row_key: Sequence[str],
    rules: dict[str, str | None] | None = None,
    where: Column | None = None,
    hide_unknown_text: bool = False,
) -> DataFrame:
    """K1-K6: masked copy of a table.

    ``rules`` overrides the rule of single columns. ``row_key`` names the columns that tell
    rows apart. ``where`` limits masking to some rows (K7). ``hide_unknown_text`` replaces
    text columns no rule knows by pseudonyms instead of passing them through. A salt is required: without
    one, ids could be found again by counting through them.
    """
    if not salt:
        raise ValueError("masking needs a salt")
    types = dict(df.dtypes)
    out = []
    for name in df.columns:
        rule = rules[name] if rules and name in rules else rule_for(name)
        if rule is None and hide_unknown_text and types[name] == "string":
            rule = "id"
        c = F.col(f"`{name}`")
        if rule is None:
            out.append(c)
            continue
        text = c.cast("string")
        if rule == "id":
            fake = pseudonym(text, salt)
        else:
            fake = _fake(rule, text, digest(salt, F.lit(name), *[F.col(f"`{k}`") for k in row_key]))
        out.append((F.when(where, fake).otherwise(text) if where is not None else fake).alias(name))
    return df.select(*out)


def mask_rows(df: DataFrame, salt: str, row_key: Sequence[str] = (), hide_unknown_text: bool = False) -> DataFrame:
    """K1-K6 for a table that may have no key: without one, rows are told apart by one digest of all their cells."""
    if row_key:
        return mask_table(df, salt, row_key, hide_unknown_text=hide_unknown_text)
    key = "_key"
    while key in df.columns:
        key += "_"
    keyed = df.withColumn(key, digest(salt, F.lit(""), *[F.col(f"`{c}`") for c in df.columns]))
    return mask_table(keyed, salt, [key], {key: None}, hide_unknown_text=hide_unknown_text).drop(key)


def masked_row(line: Column, header_line: Column, cells: Column, hints: Sequence[str]) -> Column:
    """K7: rows of a sheet to mask: all below the header, and banner rows that are mostly
    data (fewer than 40 % of their filled cells look like header words)."""
    folded = F.transform(cells, lambda x: fold_text(F.coalesce(x, F.lit(""))))
    filled = F.size(F.filter(folded, lambda x: x != ""))
    known = F.size(F.filter(folded, lambda x: has_hint(x, hints)))
    banner = F.coalesce(F.try_divide(known, filled) < 0.4, F.lit(False))
    return (line > header_line) | ((line < header_line) & banner)


def has_hint(text: Column, hints: Sequence[str]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(text, F.lit(h))
    return out
