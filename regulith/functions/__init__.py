"""Pure ``Column -> Column`` helpers; everything stays inside Catalyst expressions."""
