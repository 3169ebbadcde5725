"""Made-up lead rows in both header vocabularies."""

STATEMENT = "Lead Statement"
ADDRESS1 = "Address 1 (Road/Street/Lane/Park/Industrial Estate)"
ADDRESS2 = "Address 2 (Village/Town/City)"
POSTCODE = "Post Code (Please Put The Full Postcode, Example: CH41 5LH)"


def base_row(name, phone, url, *, message="Doors open on Monday!", postcode="LS1 4AP", at="2025-03-04 09:05:00", town="Leeds"):
    return {
        STATEMENT: message, "Timestamp": at, "Company Name": name, "Phone Number": phone,
        ADDRESS1: "1 Mill Lane", ADDRESS2: town, "Phone 2": "", POSTCODE: postcode,
        "Lead Proof URL": url,
    }


def secondary_row(name, phone, url, *, message="Doors open on Monday!", postcode="LS1 4AP", posted="2025-03-04 08:00:00"):
    return {
        "Timestamp": "2025-03-04 08:40:00", "Company Name": name, "Phone Number": phone,
        "Industry Type": "Food", POSTCODE: postcode, ADDRESS1: "1 Mill Lane", ADDRESS2: "Leeds",
        "County": "West Yorkshire", "Phone 2": "", "Phone 3": "", "Lead Proof URL": url,
        "Lead Posting Date": posted, STATEMENT: message,
    }


def secondary_row_spaced(name, phone, url):
    return {
        "Timestamp": "2025-03-04 08:40", "Primary Contact ": phone, "Secondary Contact ": "",
        "Company Name  ": name, "Business Type": "Food", "Address 1 (Road or Street)  ": "1 Mill Lane",
        "Address 2 (Town or City) ": "Leeds", "Postal Code ": "LS1 4AP",
        'Email Address ("." if None)': ".", "Lead Proof URL ": url, "Number Found URL ": "",
        "Business Note ": "Doors open!", "Column 13": "",
    }


# Generated firms: trade and street by number, phone and post id from it.
TRADES = ("Plumber", "Florist", "Dentist", "Garage", "Tailor", "Optician", "Brewery", "Pharmacy")


def number(i):
    """National digits of firm i."""
    return f"1{i:03d}200{i:03d}"


def firm(i):
    return f"{TRADES[i % len(TRADES)]} No {i}"


def post(i, host="www.facebook.com", tail=""):
    return f"https://{host}/firm{i}/posts/{900000 + i}{tail}"


A_BASE = base_row(firm(1), "0" + number(1), post(1, tail="?fbclid=t1"))
B_BASE = base_row(firm(2), "0044 " + number(2), f"https://www.facebook.com/permalink.php?story_fbid=900002&id=2", postcode="BT1 2AA")
D_BASE = base_row(firm(4), "+44" + number(4), "", postcode="CF10 4DD")
# The first firm again by its phone, a new firm, and the fourth firm under a second phone.
A_SECOND = secondary_row(firm(1) + " Limited", "44" + number(1), post(1, host="m.facebook.com"))
C_SECOND = secondary_row(firm(3), "0" + number(3), post(3), postcode="EH3 3CC")
D_SECOND = secondary_row(firm(4) + " Ltd", "0" + number(40), post(4), postcode="CF10 4DD")


def items(spark, source, rows):
    schema = "source string, raw_payload map<string,string>"
    return spark.createDataFrame([(source, r) for r in rows], schema)
