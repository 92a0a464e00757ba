"""Rules as values on the driver, and the compiler from rules to DataFrame joins."""
