"""Word boxes of invented pages, for tests: text is set at a place, a word's width follows its letters."""

SIZE = 7.5


class Pages:
    """Collects words (document_id, page_no, word_no, text, x0, y0, x1, y1) in the order they are set."""

    def __init__(self, document_id):
        self.document_id, self.page_no, self.words = document_id, 0, []

    def page(self):
        self.page_no += 1
        return self

    def left(self, x, y, text):
        for word in text.split(" "):
            if word:
                self.words.append((self.document_id, self.page_no, len(self.words), word, float(x), y - 6.0, x + SIZE / 2 * len(word), y + 2.0))
            x += SIZE / 2 * (len(word) + 1)

    def right(self, x, y, text):
        self.left(x - SIZE / 2 * len(text), y, text)

    def middle(self, x, y, text):
        self.left(x - SIZE / 4 * len(text), y, text)


WORDS = "document_id long, page_no int, word_no long, text string, x0 double, y0 double, x1 double, y1 double"
