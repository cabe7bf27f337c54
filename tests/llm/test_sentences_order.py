from linkmill.llm import toxicity


def test_words_are_numbered_alike_in_every_run():
    words = [f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    assert toxicity.Sentences([" ".join(reversed(words))]).words == words
