LONG = " ".join(f"word{k % 977} tail{k % 31}" for k in range(30_000))
#: Nulls, empty and white texts, a long one, copies, a repeated row, marks, other scripts.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, LONG), (6, LONG), (7, "Ünïcode ΑΣ İ 日本語 🦊 x y \x1c z"),
    (8, "a a a a a a a a a a a a a a a a a a a a a a a a a a"), (9, "\x00\x01 nul <|endoftext|> ▁▁ end  "), (10, "tie"), (11, "tie"), (11, "tie"),
    (None, "no id"), (12, "line\nline\nline\n"),
]
