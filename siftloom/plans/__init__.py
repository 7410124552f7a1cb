"""Ready-made query plans over the tables of the data model."""
