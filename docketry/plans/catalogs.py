"""Small fixed tables: forums, rules, tactics. Callers may pass their own."""

# Codes and names of the forums in the test tables.
FORUMS = (
    ("AVL", "Averland"), ("BRN", "Brannock"), ("CST", "Costrel"), ("DVM", "Dovemarch"), ("EKR", "Ekarrow"), ("FNW", "Fenwarren"), ("GLT", "Galtrine"), ("HRB", "Harbesk"), ("ILM", "Ilmont"), ("JSP", "Jasperoy"), ("KLD", "Keldane"), ("LRM", "Lorimar Vale"),
    ("MNV", "Minvarra"), ("NRH", "Northolm"), ("OSK", "Oskenna"), ("PTR", "Petrowane"), ("QLL", "Quillane"), ("RVS", "Rivasco"), ("SLV", "Sylvarne"), ("TRD", "Tredmoor"), ("ULM", "Ulmeday"), ("VSP", "Vesperton"), ("WCK", "Wickmere"), ("YRL", "Yarlow"),
)

# Codes, names and circuits of the forums of the United States.
US_FORUMS = (
    ("AL", "Alabama", "CA11"), ("AK", "Alaska", "CA9"), ("AZ", "Arizona", "CA9"), ("AR", "Arkansas", "CA8"), ("CA", "California", "CA9"), ("CO", "Colorado", "CA10"), ("CT", "Connecticut", "CA2"), ("DE", "Delaware", "CA3"), ("FL", "Florida", "CA11"), ("GA", "Georgia", "CA11"),
    ("HI", "Hawaii", "CA9"), ("ID", "Idaho", "CA9"), ("IL", "Illinois", "CA7"), ("IN", "Indiana", "CA7"), ("IA", "Iowa", "CA8"), ("KS", "Kansas", "CA10"), ("KY", "Kentucky", "CA6"), ("LA", "Louisiana", "CA5"), ("ME", "Maine", "CA1"), ("MD", "Maryland", "CA4"),
    ("MA", "Massachusetts", "CA1"), ("MI", "Michigan", "CA6"), ("MN", "Minnesota", "CA8"), ("MS", "Mississippi", "CA5"), ("MO", "Missouri", "CA8"), ("MT", "Montana", "CA9"), ("NE", "Nebraska", "CA8"), ("NV", "Nevada", "CA9"), ("NH", "New Hampshire", "CA1"), ("NJ", "New Jersey", "CA3"),
    ("NM", "New Mexico", "CA10"), ("NY", "New York", "CA2"), ("NC", "North Carolina", "CA4"), ("ND", "North Dakota", "CA8"), ("OH", "Ohio", "CA6"), ("OK", "Oklahoma", "CA10"), ("OR", "Oregon", "CA9"), ("PA", "Pennsylvania", "CA3"), ("RI", "Rhode Island", "CA1"), ("SC", "South Carolina", "CA4"),
    ("SD", "South Dakota", "CA8"), ("TN", "Tennessee", "CA6"), ("TX", "Texas", "CA5"), ("UT", "Utah", "CA10"), ("VT", "Vermont", "CA2"), ("VA", "Virginia", "CA4"), ("WA", "Washington", "CA9"), ("WV", "West Virginia", "CA4"), ("WI", "Wisconsin", "CA7"), ("WY", "Wyoming", "CA10"),
    ("DC", "District of Columbia", "CADC"), ("AS", "American Samoa", "CA9"), ("GU", "Guam", "CA9"), ("MP", "Northern Mariana Islands", "CA9"), ("PR", "Puerto Rico", "CA1"), ("VI", "U.S. Virgin Islands", "CA3"),
)

#: Rules by name, in the rule language, over the context of operators.cases.context().
RULES = {
    "plea-coercion": 'when case.plea_sentence_ratio < 0.5 and case.evidence_strength == "weak" then flag "Possible plea coercion" severity high',
    "selective-prosecution": 'when case.charge_category in ("drug", "possession") and case.outcome == "conviction" and case.defendant_race != "group_a" then flag "Selective prosecution pattern" severity medium',
    "trial-pressure": 'when features.trial_pressure == true and case.charges contains "drug" then flag "Trial pressure" severity high',
    "heavy-sentence": 'when case.sentence_months >= 120 then flag "Heavy sentence"',
}
#: A tactic and the signal it is measured by.
TACTICS = (("Withheld evidence", "finding:brady"), ("Informant benefits", "finding:giglio"), ("Jury strikes", "finding:batson"), ("Trial penalty", "trial_penalty"), ("Charge stacking", "charge_stack"), ("Unmeasured", "other"))
