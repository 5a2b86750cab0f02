from rulemill.llm import near_duplicates as nd


def test_chunks_miss_no_more_than_ten_of_five_symbols_did():
    def missed(similarity, size, chunks):
        p = similarity + (1 - similarity) / 2**nd.BITS_EACH
        return (1 - p**size - size * p ** (size - 1) * (1 - p)) ** chunks

    assert nd.ERRORS == 1
    for s in (0.7, 0.75, 0.8, 0.9):
        assert missed(s, nd.SYMBOLS, nd.CHUNKS) <= missed(s, 5, 10)
