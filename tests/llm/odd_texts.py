#: Texts that tend to break things: null, empty, white, one word, long words and lines, ties, repeats.
ODD = [None, "", " \t\n\x0b\x0c\r ", "a", "A a\x0ba\x0cA", "x" * 5000, "é ü　ß q", "the the the " * 700, "a\n\n a\nb\n a\n", "# $ % & | < > *", "\x1c\x1d\x85", "1234", "▁ ▁a  b", "<|endoftext|> a<|endoftext|>"]
