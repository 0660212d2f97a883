"""Word lists, texts and limits that results must agree on."""

# Fixed values. Colour words removed from a title before it becomes a key.
KEY_COLORS = [
    "midnight", "starlight", "ultramarine", "teal", "coral", "graphite", "alpine", "storm",
    "clay", "lavender", "mint", "sage", "sierrablue", "desert", "gold", "silver", "titanium",
    "natural", "blue", "black", "white", "red", "green", "yellow", "purple", "pink", "navy",
    "orange", "space gray", "space grey", "sierra blue", "alpine green", "alpine blue",
    "deep purple", "deep blue", "cosmic orange", "cosmic", "deep", "mocha", "brown", "beige",
    "cream", "violet", "bronze",
]

# Fixed values. Two-word colours, removed before the single words.
KEY_PHRASES = [
    "space gray", "space grey", "sierra blue", "alpine green", "alpine blue", "deep purple",
    "deep blue", "product red", "sky blue", "desert titanium", "black titanium",
    "white titanium", "natural titanium", "rose gold", "starlight silver", "cosmic orange",
]

# Fixed values. Connectivity words that do not distinguish products.
CONNECTIVITY = ["4g", "lte", "dual sim", "dual-sim"]

# Fixed values. Colour words hidden in the name a report shows.
DISPLAY_COLORS = [
    "Midnight", "Starlight", "Blue", "Black", "White", "Red", "Green", "Yellow", "Purple",
    "Pink", "Gold", "Silver", "Titanium", "Natural", "Desert", "Ultramarine", "Teal", "Coral",
    "Graphite", "Alpine", "Storm", "Clay", "Lavender", "Mint", "Sage", "Cosmic Orange",
    "Deep Blue", "Sierra Blue", "Space Gray", "Space Grey", "Deep Purple", "Product Red",
    "Sky Blue", "Desert Titanium", "Black Titanium", "White Titanium", "Natural Titanium",
    "Rose Gold", "Mocha", "Brown", "Navy", "Orange",
]

# Fixed values. SIM tokens in the order they take in a key.
SIM_TOKENS = ["esim", "nanosim", "dualsim"]

# Fixed values. Link texts that mark a variant of the same product.
VARIANT_LABELS = [
    "Dual eSIM", "Nano-SIM & eSIM", "eSIM", "Nano-SIM",
    "128GB", "256GB", "512GB", "1TB", "2TB",
]

# Fixed values. Report texts and marks.
ABSENT_TEXT = "Առկա չէ"
SAME_TEXT = "Արժեքները նույնն են"
NO_PRICE = "—"
ALERT_MARK = "❗"
OK_MARK = "✅"

# Fixed values. Out-of-stock text, the buy word, RAM spec labels.
OUT_OF_STOCK_TEXT = "Առկա չէ"
BUY_WORD = "Գնել"
RAM_LABELS = ["Օպերատիվ", "RAM"]

# Fixed values. Alert limits: a flat amount and a share of the anchor price.
FLAT_LIMIT = 3000.0
SHARE_LIMIT = 0.1
