"""Documents with columns of names that operators use themselves."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id long, size long, shard int, found string, cls long, key long, start int, row int, n long, spans string, kept string"
)


def rows(*texts, lang="en", source="s", first=0):
    return [(first + i, t, lang, source, len(t or ""), *[None] * 11) for i, t in enumerate(texts)]
