"""lineagelake: pedigree, phenotype and registry-epidemiology analytics on Spark DataFrames."""
