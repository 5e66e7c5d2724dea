"""Common table expressions shared by the SQL checks."""

from strandframe.functions.residues import LETTERS

SEQ = (
    "seq AS (SELECT doc_id AS seq_id, lang, source, "
    "upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents)"
)
NT = f"{SEQ}, nt AS (SELECT seq_id, lang, source, translate(s, '{LETTERS}', '{('ACGT' * 7)[:26]}') AS s FROM seq)"


def chars(view: str, keys: str = "seq_id", name: str = "chars") -> str:
    """One row per character with 1-based ``pos``."""
    return (
        f"{name} AS (SELECT {keys}, unnest(string_split(s, '')) AS r, "
        f"CAST(unnest(range(1, length(s) + 1)) AS BIGINT) AS pos FROM {view} WHERE length(s) > 0)"
    )


def words(view: str, k: int, keys: str = "seq_id", name: str = "words") -> str:
    """One row per overlapping word with 1-based ``pos`` (parallel unnest, linear in the text)."""
    cols = ", ".join(f"unnest(l[{i}:]) AS c{i}" for i in range(1, k + 1))
    word = " || ".join(f"c{i}" for i in range(1, k + 1))
    plain = ", ".join(x.split(" AS ")[-1].strip() for x in keys.split(","))
    return (
        f"{name} AS (SELECT {plain}, pos, {word} AS w FROM (SELECT {plain}, {cols}, "
        f"CAST(unnest(range(1, length(l) + 1)) AS BIGINT) AS pos FROM "
        f"(SELECT {keys}, string_split(s, '') AS l FROM {view} WHERE length(s) >= {k})) WHERE c{k} IS NOT NULL)"
    )


ROWS = (
    "rws AS (SELECT conv_id AS msa_id, turn AS member, role, "
    "upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) AS a FROM conversations)"
)
CELLS = (
    f"{ROWS}, cells AS (SELECT msa_id, member, role, unnest(string_split(a, '')) AS r, "
    "CAST(unnest(range(1, length(a) + 1)) AS BIGINT) AS site FROM rws WHERE length(a) > 0)"
)
QSEQ = "qseq AS (SELECT item_id AS q_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark)"
