"""Words, units and bounds of the price-list domain.

Fixed values: results depend on them, so they stand here as they are.
"""

#: Words that make another product of what they stand with (query matching).
EXCLUSIVE = (
    "sweet", "oyster", "baby", "local", "cherry", "grape", "plum", "black", "white", "red", "green", "yellow", "purple", "dried", "frozen", "canned",
    "pickled", "smoked", "wild", "sea", "mountain", "water", "bitter", "japanese", "chinese", "indian", "thai", "korean", "young", "old", "mature",
    "male", "female", "imported", "organic", "conventional", "quail", "duck", "goose", "turkey", "chicken", "flower", "leaf", "stem", "root", "seed",
    "bud", "tangerine", "lime", "lemon", "grapefruit", "mandarin", "valencia", "navel", "blood", "russet", "fingerling", "new", "beef", "pork",
    "lamb", "goat", "rabbit", "tuna", "salmon", "cod", "tilapia", "mackerel", "snapper", "cow", "soy", "coconut", "oat",
)
#: Words on size, quality or preparation (query matching).
DESCRIPTIVE = (
    "big", "large", "huge", "giant", "jumbo", "small", "mini", "tiny", "little", "medium", "regular", "standard", "fresh", "new", "premium", "grade",
    "quality", "whole", "half", "piece", "slice", "roasted", "grilled", "fried", "steamed", "boiled", "raw", "chopped", "sliced", "diced", "minced",
    "ground", "paste", "pastes", "sauce", "powder", "flakes",
)
#: The normaliser's lists leave out origin, age and husbandry as exclusive, and count husbandry as descriptive.
NOUN_EXCLUSIVE = (
    "sweet", "oyster", "baby", "local", "cherry", "grape", "plum", "black", "white", "red", "green", "yellow", "purple", "dried", "frozen", "canned",
    "pickled", "smoked", "wild", "sea", "mountain", "water", "bitter", "quail", "duck", "goose", "turkey", "chicken", "flower", "leaf", "stem",
    "root", "seed", "bud", "tangerine", "lime", "lemon", "grapefruit", "mandarin", "valencia", "navel", "blood", "russet", "fingerling", "new",
    "beef", "pork", "lamb", "goat", "rabbit", "tuna", "salmon", "cod", "tilapia", "mackerel", "snapper", "cow", "soy", "coconut", "oat",
)
NOUN_DESCRIPTIVE = (
    "big", "large", "huge", "giant", "jumbo", "small", "mini", "tiny", "little", "medium", "regular", "standard", "fresh", "new", "premium", "grade",
    "quality", "whole", "half", "piece", "slice", "roasted", "grilled", "fried", "steamed", "boiled", "raw", "chopped", "sliced", "diced", "minced",
    "ground", "paste", "pastes", "sauce", "powder", "flakes", "imported", "organic", "conventional",
)
#: Of the exclusive words, those that a plain query never means.
STRONG = ["sweet", "bitter", "sour", "wild", "organic", "baby"]

#: Product words of Indonesian and Spanish price lists in English.
TRANSLATIONS = {
    **{"wortel": "carrot", "wortels": "carrot", "kentang": "potato", "tomat": "tomato", "bawang": "onion", "bayam": "spinach", "kangkung": "water spinach", "sawi": "mustard greens", "terong": "eggplant", "timun": "cucumber", "jamur": "mushroom", "kubis": "cabbage", "kol": "cabbage", "brokoli": "broccoli", "kembang": "cauliflower", "paprika": "bell pepper", "cabe": "chili", "cabai": "chili", "labu": "pumpkin", "jagung": "corn", "selada": "lettuce"},
    **{"zanahoria": "carrot", "papa": "potato", "patata": "potato", "cebolla": "onion", "espinaca": "spinach", "berenjena": "eggplant", "pepino": "cucumber", "champiñón": "mushroom", "champiñones": "mushroom", "hongo": "mushroom", "hongos": "mushroom", "repollo": "cabbage", "coliflor": "cauliflower", "pimiento": "bell pepper", "calabaza": "pumpkin", "maíz": "corn", "lechuga": "lettuce"},
    **{"apel": "apple", "jeruk": "orange", "pisang": "banana", "mangga": "mango", "nanas": "pineapple", "semangka": "watermelon", "melon": "melon", "anggur": "grape", "pir": "pear", "strawberi": "strawberry", "alpukat": "avocado", "pepaya": "papaya", "jambu": "guava", "durian": "durian", "rambutan": "rambutan", "manggis": "mangosteen", "kelapa": "coconut", "nangka": "jackfruit"},
    **{"manzana": "apple", "naranja": "orange", "plátano": "banana", "piña": "pineapple", "sandía": "watermelon", "melón": "melon", "uva": "grape", "uvas": "grape", "fresa": "strawberry", "aguacate": "avocado", "palta": "avocado", "coco": "coconut"},
    **{"ayam": "chicken", "daging": "beef", "sapi": "beef", "babi": "pork", "ikan": "fish", "udang": "shrimp", "cumi": "squid", "kepiting": "crab", "kerang": "clam", "telur": "egg"},
    **{"pollo": "chicken", "carne": "meat", "cerdo": "pork", "pescado": "fish", "camarón": "shrimp", "camarones": "shrimp", "calamar": "squid", "cangrejo": "crab", "huevo": "egg", "huevos": "egg"},
    **{"beras": "rice", "gula": "sugar", "garam": "salt", "minyak": "oil", "tepung": "flour", "roti": "bread", "keju": "cheese", "susu": "milk", "krupuk": "cracker", "kerupuk": "cracker", "tempe": "tempeh", "tahu": "tofu", "kecap": "soy sauce", "sambal": "chili sauce"},
    **{"putih": "white", "merah": "red", "hijau": "green", "kuning": "yellow", "kupas": "peeled", "kriting": "curly", "harum": "aromatic", "daun": "leaf", "segar": "fresh", "fuji": "fuji"},
    **{"arroz": "rice", "azúcar": "sugar", "sal": "salt", "aceite": "oil", "harina": "flour", "pan": "bread", "queso": "cheese", "leche": "milk"},
}

#: unit: (canonical unit, units of it, kind).
UNITS = {
    **{u: ("kg", 1.0, "weight") for u in ("kg", "kgs", "kilogram", "kilo")},
    **{u: ("kg", 0.001, "weight") for u in ("g", "gr", "gram")},
    **{u: ("kg", 0.000001, "weight") for u in ("mg", "milligram")},
    **{u: ("ltr", 1.0, "volume") for u in ("l", "ltr", "liter", "litre")},
    **{u: ("ltr", 0.001, "volume") for u in ("ml", "milliliter")},
    **{u: ("pcs", 1.0, "count") for u in ("pcs", "pc", "piece", "pieces", "butir", "buah", "biji", "unit", "units")},
    **{u: ("pcs", 12.0, "count") for u in ("dozen", "dz", "lusin")},
    **{u: ("pak", 1.0, "pack") for u in ("pak", "pack", "paket", "package")},
    **{u: ("dus", 1.0, "pack") for u in ("dus", "box", "carton", "kotak")},
    **{u: ("bunch", 1.0, "special") for u in ("sisir", "ikat")},
    **{u: (c, 1.0, "special") for u, c in (("lembar", "sheet"), ("karung", "sack"), ("tray", "tray"), ("cup", "cup"), ("bottle", "bottle"), ("can", "can"), ("jar", "jar"), ("bag", "bag"), ("pouch", "pouch"))},
}
#: What the older converter knows; there a dozen is one box.
OLD_UNITS = {
    "kg": ("kg", 1.0),
    "kgs": ("kg", 1.0),
    "kilogram": ("kg", 1.0),
    "kilo": ("kg", 1.0),
    "g": ("kg", 0.001),
    "gr": ("kg", 0.001),
    "gram": ("kg", 0.001),
    "l": ("ltr", 1.0),
    "ltr": ("ltr", 1.0),
    "liter": ("ltr", 1.0),
    "litre": ("ltr", 1.0),
    "ml": ("ltr", 0.001),
    "pcs": ("pcs", 1.0),
    "pc": ("pcs", 1.0),
    "piece": ("pcs", 1.0),
    "pieces": ("pcs", 1.0),
    "butir": ("pcs", 1.0),
    "buah": ("pcs", 1.0),
    "biji": ("pcs", 1.0),
    "pak": ("pak", 1.0),
    "pack": ("pak", 1.0),
    "paket": ("pak", 1.0),
    "dus": ("dus", 1.0),
    "box": ("dus", 1.0),
    "sisir": ("bunch", 1.0),
    "lembar": ("sheet", 1.0),
    "karung": ("sack", 1.0),
    "ikat": ("bunch", 1.0),
    "dozen": ("dus", 1.0),
}

#: unit: (grams, millilitres or pieces in one, unit shown).
MEASURES = {
    **{u: (1000.0, "kg") for u in ("kg", "kilogram", "kilograms", "kilo")},
    **{u: (1.0, "g") for u in ("g", "gram", "grams", "gr")},
    **{u: (453.592, "lb") for u in ("lb", "pound", "pounds", "lbs")},
    **{u: (28.3495, "oz") for u in ("oz", "ounce", "ounces")},
    **{u: (1000.0, "l") for u in ("l", "liter", "litre", "liters", "litres")},
    **{u: (1.0, "ml") for u in ("ml", "milliliter", "milliliters")},
    **{u: (1.0, "pcs") for u in ("pcs", "piece", "pieces", "pc", "each", "item", "unit")},
    **{u: (1.0, "bunch") for u in ("sisir", "ikat", "bunch", "bundle")},
}

#: category: (words, least and most plausible price, usual units), in the order in which they are tried.
PRICE_BOUNDS = {
    "cheese": (("cheese", "keju", "mozzarella", "cheddar", "parmesan", "gouda", "brie", "mascarpone", "ricotta",), 50_000, 5_000_000, ("kg", "gr", "pack", "pcs",)),
    "milk": (("milk", "susu", "yogurt",), 10_000, 500_000, ("ltr", "ml", "pack", "bottle",)),
    "cream": (("cream", "butter", "mentega", "whipping", "sour cream",), 20_000, 5_000_000, ("kg", "gr", "ltr", "ml", "pack",)),
    "seafood": (("fish", "ikan", "salmon", "tuna", "shrimp", "udang", "crab", "lobster", "squid",), 20_000, 3_000_000, ("kg", "gr", "pcs", "pack",)),
    "vegetables": (("vegetable", "sayur", "tomato", "potato", "carrot", "onion", "garlic", "lettuce",), 5_000, 200_000, ("kg", "gr", "pack", "bundle",)),
    "fruits": (("fruit", "buah", "apple", "orange", "banana", "mango", "strawberry", "berry",), 5_000, 500_000, ("kg", "gr", "pack", "pcs",)),
    "meat": (("meat", "daging", "beef", "chicken", "lamb", "pork", "sausage", "bacon", "brisket", "steak",), 2_000, 1_000_000, ("kg", "gr", "pack", "pcs",)),
    "beverages": (("juice", "jus", "coffee", "kopi", "tea", "teh", "soda", "water", "air",), 5_000, 300_000, ("ltr", "ml", "bottle", "can", "pack",)),
    "groceries": (("rice", "beras", "oil", "minyak", "sugar", "gula", "salt", "garam", "flour", "tepung", "sauce", "paste",), 1_000, 2_000_000, ("kg", "gr", "ltr", "pack", "pcs",)),
    "specialty": (("truffle", "honey", "madu", "nuts", "almond", "pistachio", "pecan", "walnut", "dried",), 10_000, 10_000_000, ("kg", "gr", "pack",)),
}
LEAST_PRICE, MOST_PRICE, LOW_PRICE, HIGH_PRICE = 500, 50_000_000, 1_000, 10_000_000

#: Words of category headings in price lists.
HEADING_WORDS = (
    "vegetable", "fruit", "meat", "seafood", "dairy", "grain", "spice", "herb", "fresh", "frozen", "organic", "category", "section", "group", "type",
    "sayur", "buah", "daging", "ikan", "susu", "rempah", "segar", "kategori", "jenis", "bagian",
)
#: Words that only products have.
PRODUCT_WORDS = (
    "grade", "quality", "premium", "fresh", "organic", "local", "large", "small", "medium", "big", "baby", "mini", "red", "green", "white", "yellow",
    "brown",
)
#: Cosine similarity from which an embedding's neighbour counts, by category.
COSINE_LIMITS = {"Vegetables": 0.85, "Meat": 0.82, "Seafood": 0.82, "Dairy": 0.83, "Grains": 0.80, "Other": 0.80}
#: Replacements that undo common misreadings, in the order in which they are tried.
MISREADINGS = (("z", "zz"), ("zz", "z"), ("nn", "n"), ("naise$", "nnaise"), ("nnaise$", "naise"))
#: Dollars for a thousand tokens: (prompt, answer). Unknown models cost what the first one does.
TOKEN_RATES = {
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4o": (0.0025, 0.01),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "gpt-o3": (0.06, 0.24),
    "gpt-o3-mini": (0.003, 0.012),
}
#: The model whose rates a name stands for: the first part that it contains.
MODEL_NAMES = (("gpt-4o-mini", "gpt-4o-mini"), ("gpt-4o", "gpt-4o"), ("gpt-o3-mini", "gpt-4o-mini"), ("gpt-o3", "gpt-4o"), ("gpt-4", "gpt-4o"), ("gpt-3.5", "gpt-3.5-turbo"))
#: The second service's rates, by the whole name; unknown models cost what the first one does.
SERVICE_RATES = {
    "gemini-2.0-flash": (0.00001875, 0.000075),
    "gemini-2.0-flash-exp": (0.0, 0.0),
    "gemini-1.5-pro": (0.00125, 0.005),
    "gemini-1.5-flash": (0.0000625, 0.00025),
}

#: Categories by words that a name contains, in the order in which they are tried: of the upload, ...
UPLOAD_CATEGORIES = {
    "Vegetables": ("asparagus", "tomato", "onion", "carrot", "potato", "cabbage", "lettuce", "spinach", "broccoli", "cauliflower", "pepper", "cucumber", "celery", "zucchini", "eggplant", "bean", "pea", "corn", "mushroom", "vegetable"),
    "Meat": ("beef", "chicken", "pork", "meat", "lamb", "duck", "turkey", "sausage", "bacon"),
    "Seafood": ("fish", "seafood", "tuna", "salmon", "shrimp", "crab", "lobster", "squid", "prawn"),
    "Grains": ("rice", "bread", "grain", "flour", "pasta", "noodle", "wheat", "oat", "barley"),
    "Dairy": ("milk", "cheese", "dairy", "yogurt", "butter", "cream"),
}
#: ... of the shared helpers, by whole words, ...
SHARED_CATEGORIES = {
    "Dairy": ("milk", "susu", "dairy", "yogurt", "yoghurt", "cheese", "keju", "butter", "mentega", "cream", "krim"),
    "Eggs": ("egg", "telur", "eggs"),
    "Meat & Poultry": ("chicken", "ayam", "beef", "sapi", "meat", "daging", "pork", "babi", "lamb", "domba", "fish", "ikan", "seafood"),
    "Fruits & Vegetables": ("vegetable", "sayur", "veggie", "fruit", "buah", "apple", "apel", "banana", "pisang", "orange", "jeruk", "tomato", "tomat"),
    "Bakery": ("bread", "roti", "cake", "kue", "pastry", "croissant", "donut", "muffin", "bakery"),
    "Beverages": ("drink", "minuman", "beverage", "juice", "jus", "soda", "cola", "water", "air", "coffee", "kopi", "tea", "teh"),
    "Grains & Cereals": ("rice", "beras", "nasi", "wheat", "gandum", "flour", "tepung", "pasta", "noodle", "mie", "cereal", "oat"),
    "Condiments & Sauces": ("sauce", "saus", "ketchup", "kecap", "mayonnaise", "mayo", "mustard", "vinegar", "cuka", "oil", "minyak", "salt", "garam", "pepper", "lada", "spice", "bumbu"),
    "Snacks": ("snack", "chips", "keripik", "crisp", "biscuit", "biskuit", "cookie", "cracker", "chocolate", "coklat", "candy", "permen"),
    "Frozen": ("frozen", "beku", "ice cream", "es krim"),
}
#: ... of the repair of standard names (otherwise OTHER), ...
REPAIR_CATEGORIES = {
    "VEGETABLE": ("potato", "carrot", "spinach", "broccoli", "cabbage", "lettuce", "tomato", "onion", "garlic", "bean", "corn", "cucumber", "eggplant", "pepper"),
    "FRUIT": ("banana", "apple", "orange", "mango", "grape", "watermelon", "pineapple", "avocado", "strawberry", "lemon", "plantain"),
    "MEAT": ("chicken", "beef", "pork", "lamb", "meat"),
    "SEAFOOD": ("fish", "shrimp", "squid", "crab", "lobster", "salmon", "tuna"),
    "DAIRY": ("milk", "cheese", "yogurt", "butter", "cream"),
    "GRAIN": ("rice", "bread", "noodle", "pasta", "flour", "wheat"),
}
#: ... and of the clean-up of dairy names (otherwise OTHER).
DAIRY_CATEGORIES = {
    "DAIRY": ("yogurt", "kefir", "cheese", "mascarpone", "ricotta", "cottage", "milk", "cream"),
    "MEAT": ("dumpling",),
}
