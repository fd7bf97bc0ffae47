"""Registered queries over the driver's tables, each with the SQL it must agree with.

``inputs`` reshapes the tables into raw cluster objects, ``sql`` holds the same facts as flat SQL views; the modules
next to them pair every operator of the library with its expected result.
"""
