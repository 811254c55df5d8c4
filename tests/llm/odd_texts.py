#: Nulls, empty and white texts, one word, one very long word, many words, characters beyond ASCII, NUL, ties, lines.
ODD = [None, "", "   \n\t", "word", "x" * 5000, "a b c d " * 3000, "é ü ß 𝔘 \x00 end", "same text here now", "same text here now", "A\nB\nA\nB\n" * 50]
