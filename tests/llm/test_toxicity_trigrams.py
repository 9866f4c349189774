"""The character model counts all documents, not only labelled ones."""

from graphmill.llm import toxicity


def test_unlabelled_documents_count(spark):
    docs = spark.createDataFrame([(k, "nice bad"[5 * (k % 2) :][:4].strip() + f" word{k}") for k in range(40)] + [(99, "zyxwv zyxwv")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    chars = toxicity.train(docs, labels).chars
    alone = toxicity.char_model(docs.filter("doc_id < 99"))
    assert (chars.counts == toxicity.char_model(docs).counts).all() and (chars.counts != alone.counts).any()


def test_cells_hold_every_trigram(spark):
    texts = ["été çà зд 日本語テキスト w0rd", "the tree and the house", "", "a"]
    words = [toxicity.core(w) for t in texts for w in t.lower().split()]
    plain = toxicity.CharModel.trigrams({w: words.count(w) for w in words})
    model = toxicity.char_model(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert (model.counts == toxicity.CharModel.of(plain).counts).all() and model.total == sum(plain.values())


def test_viterbi_finds_the_best_path():
    """Against all paths of small lattices."""
    model = toxicity.CharModel.of(toxicity.CharModel.trigrams({"idiot": 50, "is": 40, "at": 30, "tea": 20, "see": 20, "a": 60}))

    def paths(text, k):
        if k == len(text):
            yield "", 0.0
            return
        for end, meant, channel in toxicity.arcs(text, k):
            for rest, cost in paths(text, end):
                yield meant + rest, channel + cost

    def cost(meant):
        total, now = 0.0, "  "
        for c in meant:
            if c == " " and now[1] == " ":
                now = "  "
                continue
            total += model.cost(now + c)
            now = now[1] + c if c != " " else "  "
        return total + (model.cost(now + " ") if now[1] != " " else 0)

    for text in ("1d10t", "1 d", "s333", "@ t3a", "i.d.i", "$ee", "aaaa"):
        found = toxicity.viterbi(text, model)
        best = min((channel + cost(meant), " ".join(meant.split())) for meant, channel in paths(text, 0))
        assert min(channel + cost(meant) for meant, channel in paths(text, 0) if " ".join(meant.split()) == found) <= best[0] + 1e-9, text
